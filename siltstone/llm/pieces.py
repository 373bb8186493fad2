"""Cutting texts into pieces under a size limit at natural boundaries, with overlap.

A text is taken as bytes, each byte one character (ISO-8859-1), so that bounded quantifiers count bytes. One
regular expression consumes a piece at a time: its alternatives are ordered by the strength of the boundary (end
of the text, paragraph, line, sentence, word), each greedy up to the limit, with a whole character as the last
resort. What it consumes is the part behind the piece before; the overlap is looked back for, and as that may have to
move back to the start of a character, there is one set of alternatives for each way it can go. SQL array
functions turn the lengths into offsets.

Stored pieces are judged with the same alternatives, anchored at their own start. There texts are worked on in segments of
bounded length, so a very long text, or one with a third of all pieces, is spread over many rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ordered import with_neighbours

SEGMENT = 16384
CONT, HEAD = r"[\x80-\xbf]", r"[^\x80-\xbf]"
LATIN = "ISO-8859-1"


@dataclass(frozen=True)
class PieceLimit:
    capacity: int = 2048
    overlap: int = 256
    window_from: int = 1229

    def __post_init__(self):
        if not 4 * self.overlap <= self.window_from <= self.capacity or self.overlap < 4:
            raise ValueError("the overlap must be from 4 bytes to a quarter of window_from")


def piece_limit(size_limit: DataFrame, name: str = "piece") -> PieceLimit:
    """The named row of the limits, a table of a few rows; the defaults where it is missing."""
    row = size_limit.filter(F.col("limit_name") == name).select("capacity", "overlap", "window_from").orderBy("capacity").head()
    return PieceLimit(*row) if row else PieceLimit()


def _natural(least: int, most: int) -> str:
    """Consumes from least to most bytes up to a natural boundary, the strongest first."""
    span = lambda n: f".{{{max(0, least - n)},{most - n}}}"
    return "|".join([span(2) + r"\n\n", span(1) + r"\n", span(1) + r"[.!?;](?=[ \n])", span(1) + " "])


def _piece(least: int, most: int) -> str:
    return rf"(?:.{{1,{most}}}\z|{_natural(least, most)}|.{{1,{most}}}(?!{CONT}))"


def pattern(limit: PieceLimit) -> str:
    """Consumes what the next piece has beyond its overlap with the piece before."""
    c, o, w = limit.capacity, limit.overlap, limit.window_from
    later = [f"(?<={HEAD}{CONT}{{{back}}}.{{{o - 1}}}){_piece(w - o - back, c - o - back)}" for back in range(4)]
    return rf"(?s)\A{_piece(w, c)}|" + "|".join(later)


def split_texts(docs: DataFrame, limit: PieceLimit = PieceLimit(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seq, boff, blen) of the pieces of each text, in bytes of UTF-8.

    Every piece has at most ``capacity`` bytes, starts and ends between characters and, but for the last, ends
    at the strongest boundary (of these the last) that lies from ``window_from`` to ``capacity`` bytes after its
    start, or before the last character that fits. Each later piece starts ``overlap`` bytes before the end of the
    one before, moved back to the start of a character. A text up to the capacity is one piece; null and empty
    texts have none. Repeated ids are cut row by row; other columns are not read.
    """
    o = limit.overlap
    latin = docs.select(F.col(id_col).alias("doc_id"), F.decode(F.encode(text_col, "UTF-8"), LATIN).alias("t")).filter("length(t) > 0")
    # a part but the last is longer than the overlap, so the overlap's start is inside it
    seam = lambda p: F.substr(p, F.length(p) - F.lit(o + 2), F.lit(4))
    back = lambda p: F.length(F.regexp_extract(seam(p), rf"(?s){HEAD}({CONT}*)\z", 1))
    part = lambda p: F.struct(F.length(p).alias("n"), F.when(F.length(p) > o + 3, back(p)).otherwise(0).alias("back"))
    cut = latin.select("doc_id", F.transform(F.regexp_extract_all("t", F.lit(pattern(limit)), F.lit(0)), part).alias("parts"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    step = lambda a, p: F.struct((a["at"] + p["n"]).alias("at"), F.array_append(a["ends"], a["at"] + p["n"]).alias("ends"))
    cut = cut.select("doc_id", "parts", F.aggregate("parts", none, step, lambda a: a["ends"]).alias("ends"))
    start = lambda e, i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1) - o - F.get("parts", i - 1)["back"])
    pieces = F.transform("ends", lambda e, i: F.struct(start(e, i).alias("s"), e.alias("e")))
    rows = cut.select("doc_id", F.posexplode(pieces).alias("seq", "p"))
    return rows.select("doc_id", "seq", F.col("p.s").cast("bigint").alias("boff"), (F.col("p.e") - F.col("p.s")).cast("bigint").alias("blen"))


def segments(docs: DataFrame, extra: int, size: int = SEGMENT) -> DataFrame:
    """(doc_id, seg, total, bytes): the bytes of each text from seg * size on, ``extra`` more than size of them."""
    raw = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw")).filter("doc_id is not null and length(raw) > 0")
    n = F.floor((F.length("raw") - 1) / size).cast("int")
    cut = raw.select("doc_id", "raw", F.length("raw").cast("bigint").alias("total"), F.explode(F.sequence(F.lit(0), n)).alias("seg"))
    return cut.select("doc_id", F.col("seg").cast("bigint").alias("seg"), "total", F.substring("raw", F.col("seg") * size + 1, F.lit(size + extra)).alias("bytes"))


def judge_pieces(chunks: DataFrame, docs: DataFrame, limit: PieceLimit = PieceLimit()) -> DataFrame:
    """(chunk_id, sound) for every stored piece, by the contract that split_texts() keeps.

    Pieces are taken in order of boff (null first), then chunk_id. Pieces of no or an empty text, and those with a
    null in doc_id, boff or blen, are not sound; to the piece after it a null or negative blen is 0. A cut may be at any
    natural boundary of the window; where split_texts() finds none there it may be anywhere between
    characters. Empty tables give an empty result.
    """
    c, o, w = limit.capacity, limit.overlap, limit.window_from
    own = chunks.select("chunk_id", "doc_id", "boff", "blen")
    p = with_neighbours(own, ["doc_id"], ["boff", "chunk_id"], ["boff", "blen"], "pieces")
    p = p.withColumn("seg", F.when(F.col("boff") >= 0, F.floor(F.col("boff") / SEGMENT)))
    j = p.join(segments(docs, c + 2), ["doc_id", "seg"], "left")
    j = j.withColumn("s", F.decode(F.substring("bytes", (F.col("boff") - F.col("seg") * SEGMENT + 1).cast("int"), F.lit(c + 2)), LATIN))
    n = F.when(F.col("blen").between(1, c), F.col("blen")).cast("int")
    end = F.col("boff") + n
    head = lambda x: F.coalesce(x.rlike(f"(?s)\\A{HEAD}"), F.lit(False))
    j = j.withColumn("n", n).withColumn("e", end).withColumn("tail", F.substr("s", F.col("n"), F.lit(1))).withColumn("then", F.substr("s", F.col("n") + 1, F.lit(1)))
    at_end = F.col("e") == F.col("total")
    inside = F.col("n").isNotNull() & (F.col("e") <= F.col("total")) & head(F.col("s")) & (at_end | head(F.col("then")))
    before = F.when(F.col("prev.blen") > 0, F.col("prev.blen")).otherwise(0)
    seam = F.least(F.try_add(F.col("prev.boff"), F.coalesce("prev.blen", F.lit(0))), F.col("total")) - F.least(F.lit(o), F.floor(before / 4))
    moved = F.substr("s", F.lit(2), (seam - F.col("boff")).cast("int"))
    starts = F.when(F.col("prev").isNull(), F.col("boff") == 0).when((seam >= F.col("boff")) & (seam <= F.col("boff") + 3), moved.rlike(rf"(?s)\A{CONT}*\z"))
    space = lambda x: F.col(x).isin(" ", "\n")
    natural = space("tail") | (F.col("tail").isin(".", "!", "?", ";") & space("then"))
    # the operator's own cut from this start: empty where its window has no natural boundary
    cut = F.regexp_extract("s", rf"(?s)\A(.{{{w},{c}}}\z|{_natural(w, c)})", 1)
    ends = F.when(at_end, True).when(F.col("last"), False).when(natural, True).otherwise(cut == "")
    return j.select("chunk_id", F.coalesce(inside & starts & ends, F.lit(False)).alias("sound"))
