"""URL filters: all glob rules at once, as one bit-parallel automaton.

Every rule is compiled into a row of state bits, and the rows are packed next to each
other into 64-bit words. Reading one byte of a canonical URL is the Shift-And step
`S = (((S << 1) | first) & literal[byte]) | (S & loop[byte])`: the shift moves every
rule on by one literal, and the loop masks keep the states in which a wildcard may eat
the byte. The step runs over a whole column of URLs, a byte position at a time.
Rules are few and known, so the masks (256 rows of words) travel with the function.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starcell.llm.shared import text_bytes

# A canonical URL starts with this mark, so that "*." also stands for "no subdomain".
START = "."
ADDED = ("host", "path", "rule", "verdict")
ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Rule:
    """`host/path`: the host with its subdomains, the path as a prefix; `*` in either is a glob.

    A `*` in the host stands for bytes other than `/`, one in the path for any bytes.
    """

    action: str
    pattern: str

    def __post_init__(self):
        if self.action not in ("allow", "block"):
            raise ValueError(f"action {self.action!r} is neither allow nor block")
        if "/" not in self.pattern or self.pattern.startswith("/"):
            raise ValueError(f"rule {self.pattern!r} is not host/path")

    def glob(self) -> list[tuple[str, bytes]]:
        """The canonical URL as ('text', bytes), ('host*', b'') and ('any*', b'') pieces."""
        host, path = self.pattern.split("/", 1)
        pieces: list[tuple[str, bytes]] = [("host*", b""), ("text", b".")]
        for part, star in ((host.lower(), "host*"), ("/" + path, "any*")):
            for i, text in enumerate(part.split("*")):
                pieces += [(star, b"")] * (i > 0) + [("text", text.encode())] * bool(text)
        return [*pieces, ("any*", b"")]


class Automaton:
    """Masks of a list of rules; `match` gives the winning rule of each URL, or -1."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        states: list[tuple[int, int, str, bool]] = []  # rule, byte (-1: start), loop kind, last
        for r, rule in enumerate(self.rules):
            row: list[list] = [[r, -1, "", False]]
            for kind, text in rule.glob():
                if kind == "text":
                    row += [[r, byte, "", False] for byte in text]
                elif row[-1][2] != "any*":
                    row[-1][2] = kind
            row[-1][3] = True
            states += [tuple(s) for s in row]
        self.words = max(1, -(-len(states) // 64))
        self.literal = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends = np.zeros(len(self.rules), np.int64)
        for i, (r, byte, kind, last) in enumerate(states):
            word, bit = i // 64, np.uint64(1) << np.uint64(i % 64)
            if byte < 0:
                self.start[word] |= bit
            else:
                self.literal[byte, word] |= bit
            if kind:
                eaten = np.arange(256) != ord("/") if kind == "host*" else np.ones(256, bool)
                self.loop[eaten, word] |= bit
            if last:
                self.ends[r] = i
        # The longest rule wins, then a block, then the one listed first.
        self.order = sorted(range(len(self.rules)), key=lambda r: (
            -len(self.rules[r].pattern.encode()), self.rules[r].action != "block", r))

    def match(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.full(len(starts) - 1, -1, np.int64)
        sizes = starts[1:] - starts[:-1]
        by_size = np.argsort(-sizes, kind="stable")  # those still being read are a prefix
        for first in range(0, len(by_size), ROWS_AT_ONCE):
            rows = by_size[first:first + ROWS_AT_ONCE]
            state = np.tile(self.start, (len(rows), 1))
            left = -sizes[rows]
            for at in range(-int(left[0]) if len(rows) else 0):
                live = int(np.searchsorted(left, -at, "left"))
                byte = data[starts[rows[:live]] + at]
                now = state[:live]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:live] = (moved & self.literal[byte]) | (now & self.loop[byte])
            for r in reversed(self.order):
                word, bit = self.ends[r] // 64, np.uint64(self.ends[r] % 64)
                out[rows[(state[:, word] >> bit) & np.uint64(1) == 1]] = r
        return out


def canonical(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url column; both empty without `://` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), path


def judge(pages: DataFrame, rules: Sequence[Rule], otherwise: str = "allow") -> DataFrame:
    """Adds `host`, `path`, `rule` (the winning pattern, else null) and `verdict` to rows with a `url`.

    A null url, or one without `://`, has an empty host and path, no rule and the verdict
    `otherwise`; so has every url that no rule fits. Rows are judged one by one (repeated
    rows alike, an empty table gives an empty one), nothing is shuffled, and columns of
    the input with the names of added ones are replaced. Urls may be of any length: a
    batch is read in slices of rows, and only the bits of each row are kept.
    """
    if otherwise not in ("allow", "block"):
        raise ValueError(f"verdict {otherwise!r} is neither allow nor block")
    automaton = Automaton(rules)
    names = pa.array([r.pattern for r in automaton.rules], pa.string())
    actions = pa.array([r.action for r in automaton.rules], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column("__url"))
            best = automaton.match(data, starts)
            which = pa.array(best, mask=best < 0)
            kept = [i for i, c in enumerate(batch.schema.names) if c != "__url"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], names.take(which),
                 actions.take(which).fill_null(otherwise)],
                [*[batch.schema.names[i] for i in kept], "rule", "verdict"])

    host, path = canonical(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    schema = StructType(list(pages.schema.fields)).add("rule", "string").add("verdict", "string")
    return pages.withColumn("__url", F.concat(F.lit(START), "host", "path")).mapInArrow(run, schema)
