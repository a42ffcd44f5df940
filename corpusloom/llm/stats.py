"""Statistics of one text, as an Arrow UDF that returns a struct."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import SPACES, words

#: the characters that count as symbols
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?.,;:"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
#: lead bytes of UTF-8's upper-case Latin-1 letters are C3 80 to C3 9E; they count with A-Z
UPPER_LATIN = bytes(range(0x80, 0x9F))

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct",
)
SCHEMA = T.StructType([T.StructField(name, T.LongType(), False) for name in FIELDS])


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words inside 3-word windows that the sequence holds twice or more, the first included."""
    n = len(ids)
    if n < 4 or n_distinct == n:
        return 0
    key = ids[:-2] * n_distinct + ids[1:-1]
    if n_distinct >= 2_000_000:  # the third power would pass 2**63
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    key = key * n_distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def dup_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; all lines with a word."""
    seen: set[str] = set()
    dup = total = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            total += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return dup, total


def measure(text: str | None) -> tuple[int, ...]:
    """The statistics of one text in the order of FIELDS; zeros for a null or empty one."""
    if not text:
        return (0,) * len(FIELDS)
    found = words(text)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    raw = text.encode("utf-8", "surrogatepass")
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    dup, lines = dup_lines(text)
    return (
        len(found),
        len(text) - sum(map(text.count, SPACES)),
        count(SYMBOLS),
        dup,
        repeated_words(ids, len(number)),
        lines,
        count(UPPER) + raw.count(b"\xc3") - sum(raw.count(b"\xc3" + bytes([b])) for b in range(0xA0, 0xC0)),
        count(DIGITS),
        count(MARKS),
        len(number),
    )


@F.arrow_udf(SCHEMA)
def _stats(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        rows = np.array([measure(t.as_py()) for t in batch], np.int64).reshape(-1, len(FIELDS))
        yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(FIELDS))], FIELDS)


def text_stats(text: Column) -> Column:
    """Struct of longs (FIELDS) over the whole text.

    Null and empty texts get zeros. One pass for each text, nothing is kept between texts, so memory is that of
    the longest text in a batch.
    """
    return _stats(text.cast("string"))
