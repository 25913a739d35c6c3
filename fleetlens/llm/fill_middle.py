"""Fill-in-the-middle: documents cut at two token ranks and rearranged, the ranks turned into code points by an indexable skip list.

A token is white space with the word after it, or the white space at the end of a text. Each text gets a skip list over its tokens
whose edges carry two widths: the tokens that they pass and the code points of those. A search for a rank descends from the sparsest lane
while the tokens passed do not exceed the rank, and adds up the code points, so a cut takes a logarithmic number of steps and is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, take_turn

#: What opens the prefix, the suffix and the middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = "<[PSM]>"
_SPACE = np.isin(np.arange(128), [9, 10, 11, 12, 13, 32])


def token_widths(text: str) -> np.ndarray:
    """Code points of each token of a text, in order."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    space = _SPACE[np.minimum(points, 127)]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    if len(points) and space[-1]:
        ends = np.append(ends, len(points))
    return np.diff(ends, prepend=0)


class SkipList:
    """Tokens in order under express lanes. A lane holds a quarter of the nodes of the lane below it, drawn by a hash of the place; node i
    stands before token i. Each lane keeps for its nodes the place in the lane below and, for the edge to the next node, both widths."""

    def __init__(self, widths: np.ndarray):
        n = len(widths)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.ones(n, np.int64), widths, np.arange(n + 1))]
        nodes = np.arange(n + 1, dtype=np.uint64)
        draw = nodes * np.uint64(0x9E3779B97F4A7C15)
        draw ^= draw >> np.uint64(32)
        sums = [np.concatenate(([0], np.cumsum(w))) for w in self.lanes[0][:2]]
        while len(draw) > 8:
            up = draw & np.uint64(3) == 0
            up[0] = True  # the head is in every lane
            at = np.flatnonzero(up)
            sums = [s[at] for s in sums]
            self.lanes.append((np.diff(sums[0]), np.diff(sums[1]), at))
            draw = draw[at] >> np.uint64(2)
            if len(at) == 1:
                break

    def offset(self, rank: int) -> int:
        """Code points before the token of that rank (from 0; the number of tokens gives the whole length)."""
        node, passed, points = 0, 0, 0
        for units, widths, down in reversed(self.lanes):
            while node < len(units) and passed + units[node] <= rank:
                passed += int(units[node])
                points += int(widths[node])
                node += 1
            node = int(down[node])
        return points


def draws(doc_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers of a document: the first groups of eight digits of the SHA-256 of ``seed:doc_id``; a null id reads ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, percent: int = 50, spm_percent: int = 80, seed: int = 42) -> DataFrame:
    """``docs`` (doc_id, text and more) with n_tokens, form, prefix_chars, middle_chars and output.

    ``percent`` of the documents are cut at two ranks drawn from the id and rearranged, ``spm_percent`` of those as suffix, prefix, middle
    (form spm) and the rest as prefix, suffix, middle (psm). All others keep their text (plain), as do empty texts and texts
    that hold a mark themselves; their prefix_chars and middle_chars are null. A null text is empty. Cuts may fall at either end or on each
    other, which leaves parts empty. Rows are independent: repeated rows give repeated results, and columns of ``docs`` with the name of a
    result are replaced. A text is handled whole in one row.
    """
    bounded_batches(docs.sparkSession)
    own = ("n_tokens", "form", "prefix_chars", "middle_chars", "output")
    plain = docs.drop(*own)
    name = "_draws"
    while name in plain.columns:
        name += "_"
    drawn = plain.withColumn(name, draws(F.col("doc_id"), seed))
    names, at = [*plain.columns, *own], plain.columns.index("text")
    n_cols = len(plain.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("fill")
        for b in batches:
            rows = []
            for t, h in zip(b.column(at), b.column(n_cols), strict=True):
                text, (h1, h2, h3, h4) = t.as_py() or "", h.as_py()
                widths = token_widths(text)
                n = len(widths)
                if not n or h3 % 100 >= percent or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((n, "plain", None, None, text))
                    continue
                tokens = SkipList(widths)
                first, second = sorted((tokens.offset(h1 % (n + 1)), tokens.offset(h2 % (n + 1))))
                head, middle, tail = text[:first], text[first:second], text[second:]
                spm = h4 % 100 < spm_percent
                out = (SUFFIX, tail, PREFIX, head, MIDDLE, middle) if spm else (PREFIX, head, SUFFIX, tail, MIDDLE, middle)
                rows.append((n, "spm" if spm else "psm", first, second - first, "".join(out)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:n_cols], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    new = [T.StructField(c, k()) for c, k in zip(own, (T.LongType, T.StringType, T.LongType, T.LongType, T.StringType), strict=True)]
    return drawn.mapInArrow(cut, T.StructType([*plain.schema.fields, *new]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of. Texts that hold a mark are never cut, so the three marks of a cut
    one are where it opens its parts."""
    parts = F.split(output, _MARK, -1)
    back = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(back)
