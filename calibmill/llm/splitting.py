"""Items larger than a limit, cut into overlapping pieces at natural boundaries.

Sizes are tokens of the public ByT5 tokenizer: bytes of the UTF-8 text. For each text the least number of pieces
is computed and equal-length targets placed; each is snapped to the strongest boundary nearby, then to the strongest
anywhere the limits allow, and only where there is none to a character's end. When limits can't be met a piece is added and the
targets are placed anew; so is it where a cut has no boundary, as long as fewer such cuts are thinkable and at most once for each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Strengths of boundaries; 0 is the end of a character with nothing else, 1 lies between characters of a script without spaces.
CHARACTER, UNSPACED, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)
STRENGTHS = ("character", "unspaced", "word", "clause", "sentence", "line", "paragraph")
#: How far from its target a cut looks for the strongest boundary first, as a share of a piece.
NEARBY = 0.15
# Characters of scripts written without spaces, between any two of which a line may break (kana, ideographs).
UNSPACED_CHARACTERS = "\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"

_BOUNDARY = re.compile(rf"(?<=[{UNSPACED_CHARACTERS}])(?=[{UNSPACED_CHARACTERS}])|" r"(?:(?P<s>[.!?…]+[\"')\]»”’]*(?=\s)|[。！？]+[」』）”]*)|(?P<c>[;:,](?=\s)|[、，；：]))\s*|\s+|-(?=\w)")


def _strength(found: re.Match) -> int:
    """What a stretch of punctuation and white space is worth."""
    if not found[0]:
        return UNSPACED
    lines = found[0].count("\n")
    if lines:
        return PARAGRAPH if lines > 1 else LINE
    if found["s"]:
        return SENTENCE
    if found["c"]:
        return CLAUSE
    return WORD


class Layout:
    """Where a text can be cut: the byte offsets of its characters' ends and of its boundaries with their strengths."""

    def __init__(self, text: str) -> None:
        self.data = text.encode()
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        self.ends = np.concatenate([[0], np.cumsum(widths)])
        found = [(m.end(), _strength(m)) for m in _BOUNDARY.finditer(text) if m.end() < len(text)]
        self.cuts = self.ends[[at for at, _ in found]] if found else np.empty(0, np.int64)
        self.strengths = np.array([s for _, s in found], dtype=np.int64)
        self.text = text

    def floor(self, at: int) -> int:
        """The last character's end at or before a byte offset."""
        return int(self.ends[np.searchsorted(self.ends, at, "right") - 1])

    def best(self, low: int, high: int, target: float) -> tuple[int, int] | None:
        """(offset, strength) of the strongest boundary in [low, high], the one nearest the target among equals."""
        a, b = np.searchsorted(self.cuts, low, "left"), np.searchsorted(self.cuts, high, "right")
        if a >= b:
            return None
        strengths, cuts = self.strengths[a:b], self.cuts[a:b]
        top = cuts[strengths == strengths.max()]
        return int(top[np.argmin(np.abs(top - target))]), int(strengths.max())

    def unavoidable(self, limit: int, overlap: int) -> int:
        """Cuts without a boundary that no splitting does without: those inside stretches that no piece can hold with its overlap."""
        edges = np.concatenate([[0], self.cuts[self.strengths >= WORD], [len(self.data)]])
        needed = np.diff(edges) + np.where(np.arange(len(edges) - 1) > 0, overlap, 0) - limit
        return int((-(-needed[needed > 0] // (limit - overlap))).sum())

    def anywhere(self, low: int, high: int, target: float) -> int | None:
        """The character's end in [low, high] nearest the target, before no combining mark if that can be helped."""
        a, b = np.searchsorted(self.ends, low, "left"), np.searchsorted(self.ends, high, "right")
        if a >= b:
            return None
        order = np.argsort(np.abs(self.ends[a:b] - target), kind="stable")
        for i in order:
            at = a + int(i)
            if at >= len(self.text) or not (unicodedata.combining(self.text[at]) or self.text[at] in "‍︎️"):
                return int(self.ends[at])
        return int(self.ends[a + int(order[0])])


def _cut(layout: Layout, pieces: int, limit: int, overlap: int) -> list[tuple[int, int, int]] | None:
    """(start, end, strength of the end) of so many pieces, or None where the limits can't be met."""
    total, start, out = len(layout.data), 0, []
    step = limit - overlap - 3  # new bytes that a later piece is sure to hold: its start may move by part of a character
    end = 0
    for left in range(pieces, 1, -1):
        length = (total - start + (left - 1) * overlap) / left
        low, high = max(total - (left - 1) * step, end + 1, start + overlap + 1), min(start + limit, total - 1)
        if low > high:
            if total - start <= limit:
                break  # strong boundaries far ahead have used up the text
            return None
        target = min(max(start + length, low), high)
        reach = NEARBY * length
        pick = layout.best(max(low, int(target - reach)), min(high, int(target + reach)), target) or layout.best(low, high, target)
        if pick is None:
            at = layout.anywhere(low, high, target)
            if at is None:
                return None
            pick = at, CHARACTER
        end = pick[0]
        out.append((start, *pick))
        start = layout.floor(end - overlap)
    if total - start > limit:
        return None
    return [*out, (start, total, PARAGRAPH)]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start byte, end byte, strength of the cut at its end) of the pieces of a text longer than ``limit`` bytes.

    Each piece but the first starts ``overlap`` bytes before the end of the one before, or up to three more where that
    would be inside a character. A text within the limit is one piece. The end of the text counts as strongest.
    """
    if limit < 8 or not 0 <= overlap <= limit - 8:
        raise ValueError(f"a limit of {limit} with an overlap of {overlap} leaves no room")
    layout = Layout(text)
    total = len(layout.data)
    if total <= limit:
        return [(0, total, PARAGRAPH)]
    pieces = 1 + -(-(total - limit) // (limit - overlap))
    found = _cut(layout, pieces, limit, overlap)
    while found is None:  # with so many that each takes the bytes it is sure to hold, it can't fail
        pieces += 1
        found = _cut(layout, pieces, limit, overlap)
    bare = lambda cuts: sum(s < WORD for _, _, s in cuts)
    left, fewest = bare(found), layout.unavoidable(limit, overlap) if bare(found) else 0
    for more in range(pieces + 1, pieces + left + 1):
        if bare(found) <= fewest:
            break
        other = _cut(layout, more, limit, overlap)
        if other is not None and bare(other) < bare(found):
            found = other
    return found


SCHEMA = pa.schema([("budget_id", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("n_tokens", pa.int32()), ("overlap", pa.int32()), ("cut", pa.string()), ("piece_text", pa.string())])
DDL = "budget_id int, doc_id bigint, piece int, pieces int, start_byte bigint, end_byte bigint, n_tokens int, overlap int, cut string, piece_text string"


def _split(batches: Iterator[pa.RecordBatch], budgets: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            data = text.encode()
            for budget, limit, overlap in budgets:
                if len(data) <= limit:
                    continue
                pieces, before = split_text(text, limit, overlap), 0
                for i, (start, end, strength) in enumerate(pieces):
                    rows.append((budget, doc, i, len(pieces), start, end, end - start, before - start if i else 0, STRENGTHS[strength] if i < len(pieces) - 1 else "end", data[start:end].decode()))
                    before = end
                size += len(data)
            if size > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def split_documents(documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """The pieces of every text above a ``split`` budget: budget, document, place, byte range, tokens, overlap, cut, text.

    budgets: rows of ``token_budgets``, a table of a few rows; it becomes a parameter. Texts within a budget, blank
    and null ones give no pieces for it. Only texts above the least budget reach Python; nothing is shuffled.
    """
    limits = [(r["budget_id"], r["max_tokens"], r["overlap_tokens"] or 0) for r in budgets.where("task = 'split' and max_tokens is not null").select("budget_id", "max_tokens", "overlap_tokens").collect()]
    least = min((limit for _, limit, _ in limits), default=None)
    long = documents.select("doc_id", "text").where(F.octet_length("text") > least if least is not None else F.lit(False))
    return long.mapInArrow(partial(_split, budgets=limits), DDL)


def found_split(documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, doc_id) of the documents that were split."""
    return split_documents(documents, budgets).where("piece = 0").select("budget_id", "doc_id")


def cut_counts(pieces: DataFrame) -> DataFrame:
    """(budget_id, cut, n, share): how many pieces end at which kind of boundary, the ends of texts apart."""
    counted = pieces.where("cut <> 'end'").groupBy("budget_id", "cut").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("budget_id")))


def audit(pieces: DataFrame, documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """What must hold of a splitting, counted: (budget_id, documents, bytes, over_limit, apart, torn).

    documents split and the bytes of their texts that the pieces cover once; pieces above the limit; pieces that don't start the stated
    overlap (up to three bytes more) before the end of the one before; documents whose pieces don't add up to their text.
    """
    limits = budgets.where("task = 'split'").select("budget_id", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("stated")).dropDuplicates(["budget_id"])
    order = Window.partitionBy("budget_id", "doc_id").orderBy("piece")
    rows = pieces.join(limits, "budget_id").withColumn("_end", F.lag("end_byte").over(order))
    rows = rows.withColumns({"_new": F.col("end_byte") - F.coalesce("_end", F.lit(0)), "_shared": F.col("_end") - F.col("start_byte")})
    texts = documents.select("doc_id", F.col("text").alias("_text"))
    behind = F.decode(F.substring(F.encode("piece_text", "UTF-8"), (F.octet_length("piece_text") - F.col("_new") + 1).cast("int"), F.col("_new").cast("int")), "UTF-8")
    docs = rows.withColumn("_part", behind).groupBy("budget_id", "doc_id").agg(F.sum("_new").alias("bytes"), F.count_if((F.octet_length("piece_text") > F.col("max_tokens")) | (F.octet_length("piece_text") != F.col("n_tokens"))).alias("over"), F.count_if((F.col("_shared") < F.col("stated")) | (F.col("_shared") > F.col("stated") + 3)).alias("apart"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "_part"))), lambda x: x["_part"]), "").alias("_whole"))  # a text's pieces
    checked = docs.join(texts, "doc_id", "left").withColumn("_torn", ~F.coalesce(F.col("_whole") == F.col("_text"), F.lit(False)))
    return checked.groupBy("budget_id").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.sum("over").alias("over_limit"), F.sum("apart").alias("apart"), F.count_if("_torn").alias("torn"))
