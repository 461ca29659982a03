"""Star-schema descriptions, measure blocks and the joins they share."""
