"""Column builders and argument checks shared by the operators."""
