"""Fill-in-middle transformation: cut texts at line bounds and reorder the parts.

A line starts where there is a character whose predecessor is a line feed, or none.
This predicate on two adjacent characters is counted per chunk; chunks overlap by
one byte, so each pair stands in exactly one chunk.  Prefix sums over a text's
counts tell which chunk owns the n-th line start, and only that one is searched.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

LINE = "\n"


@dataclass(frozen=True)
class Settings:
    """Sentinels, the percentage of texts that are transformed and of those that have
    the suffix first, the seed of the draws, and the bytes of a chunk."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    transformed: int = 100
    suffix_first: int = 50
    seed: int = 7
    chunk: int = 1 << 16


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers: the first groups of 8 digits of sha256(seed:doc_id).  A null
    doc_id counts as an empty one."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _feeds(piece: Column) -> Column:
    """The number of line feeds in a string."""
    return F.octet_length(piece) - F.octet_length(F.replace(piece, F.lit(LINE), F.lit("")))


def _after(piece: Column, k: Column) -> Column:
    """The byte that follows the k-th line feed (k >= 1)."""
    return F.octet_length(F.call_function("substring_index", piece, F.lit(LINE), k.cast("int"))) + 1


def _slice(data: Column, start: Column, size: Column) -> Column:
    """``size`` bytes from byte ``start`` (from 0) of a binary, as a string."""
    return F.call_function("substring", data, (start + 1).cast("int"), size.cast("int")).cast("string")


def _piece(text: Column, at: Column, size: int) -> Column:
    """The chunk that starts at byte ``at``, with the byte before it."""
    return _slice(text.cast("binary"), F.greatest(at - 1, F.lit(0)), F.when(at > 0, size + 1).otherwise(size))


def _starts(piece: Column, at: Column) -> Column:
    """Line starts in a chunk: pairs of a line feed and a next byte, and the text's own start."""
    return _feeds(piece) - F.endswith(piece, F.lit(LINE)).cast("int") + (at == 0).cast("int")


def _place(piece: Column, at: Column, k: Column) -> Column:
    """The byte in the whole text of the chunk's k-th line start (from 0)."""
    inside = _after(piece, F.when(at > 0, k + 1).otherwise(k))
    return F.when((at == 0) & (k == 0), 0).when(at > 0, at - 1 + inside).otherwise(inside)


def _cuts(n: Column, h: list[Column]) -> list[Column]:
    one, two = F.pmod(h[0], n + 1), F.pmod(h[1], n + 1)
    return [F.least(one, two), F.greatest(one, two)]


def _short(rows: DataFrame, s: Settings) -> DataFrame:
    """Texts of one chunk: counted and cut where they stand, without a shuffle."""
    text, zero = F.col("text"), F.lit(0)
    lines = F.when(text == "", 0).otherwise(_starts(text, zero)).cast("long")
    rows = rows.withColumn("n", lines)
    for name, rank in zip(("first", "second"), _cuts(F.col("n"), draws(F.col("doc_id"), s.seed)), strict=True):
        rows = rows.withColumn(name, F.when(rank == F.col("n"), F.octet_length(text)).otherwise(_place(text, zero, rank)))
    return rows


def _long(rows: DataFrame, s: Settings) -> DataFrame:
    """Texts of several chunks.  Chunks are dealt to tasks and give a count each; sums
    of counts by text find the owners, and the texts are shuffled to their cuts once."""
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"), 256)
    rows = rows.withColumn("key", key)
    ats = F.sequence(F.lit(0), F.octet_length("text") - 1, F.lit(s.chunk))
    pieces = rows.select("key", "doc_id", "text", F.explode(ats).alias("at")).select("key", "doc_id", "at", _piece(F.col("text"), F.col("at"), s.chunk).alias("piece")).repartition("key", "at")
    # a row that repeats has the same key and counts: one of them is enough
    counts = pieces.select("key", "doc_id", "at", _starts(F.col("piece"), F.col("at")).alias("held")).groupBy("key", "at").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held"))
    whole = Window.partitionBy("key")
    before = F.coalesce(F.sum("held").over(whole.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = counts.select("key", "doc_id", "at", "held", before.alias("before"), F.sum("held").over(whole).alias("n"))
    ranks = F.posexplode(F.array(*_cuts(F.col("n"), draws(F.col("doc_id"), s.seed)))).alias("which", "rank")
    owned = summed.select("key", "at", "held", "before", "n", ranks).where("(rank >= before and rank < before + held) or (rank = n and at = 0)")
    which = lambda i, c: F.max(F.when(F.col("which") == i, c))
    owner, local = F.when(F.col("rank") < F.col("n"), F.col("at")), F.col("rank") - F.col("before")
    cuts = cut(owned.groupBy("key").agg(F.max("n").cast("long").alias("n"), *[x for i in (0, 1) for x in (which(i, owner).alias(f"at{i}"), which(i, local).alias(f"k{i}"))]), "cuts")
    met = rows.join(cuts, "key")
    for i, name in enumerate(("first", "second")):
        at = F.col(f"at{i}")
        met = met.withColumn(name, F.when(at.isNull(), F.octet_length("text")).otherwise(_place(_piece(F.col("text"), at, s.chunk), at, F.col(f"k{i}"))))
    return met.select(*[c for c in rows.columns if c != "key"], "n", "first", "second")


def _marked(text: Column, s: Settings) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in (s.prefix, s.suffix, s.middle)))


def transform(docs: DataFrame, s: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, text) for each row.

    ``n`` lines; a prefix of the lesser of two drawn numbers of lines, a middle up to
    the greater, the rest is the suffix.  ``form`` is ``psm`` (sentinels before prefix,
    suffix and middle, in this order), ``spm`` (suffix, prefix, middle) or ``plain``:
    the text itself, where it is empty, holds a sentinel or isn't drawn.  A null text is
    empty; a null key draws as an empty one; repeated rows come out alike, each of
    them; other columns are dropped, whatever their names; no rows give none.

    Texts of up to ``chunk`` bytes are cut where they stand.  Longer ones go in
    overlapping chunks, at every length alike.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    small = F.octet_length("text") <= s.chunk
    columns = ["doc_id", "text", "n", "first", "second"]
    met = _short(rows.where(small), s).select(columns).unionByName(_long(rows.where(~small), s).select(columns))
    h = draws(F.col("doc_id"), s.seed)
    plain = (F.col("text") == "") | _marked(F.col("text"), s) | (F.pmod(h[2], F.lit(100)) >= s.transformed)
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < s.suffix_first, "spm").otherwise("psm")
    data = F.col("text").cast("binary")
    parts = met.select(
        "doc_id", "n", "text", form.alias("form"),
        _slice(data, F.lit(0), F.col("first")).alias("head"),
        _slice(data, F.col("first"), F.col("second") - F.col("first")).alias("body"),
        _slice(data, F.col("second"), F.octet_length("text") - F.col("second")).alias("tail"),
    )
    head, body, tail = [F.concat(F.lit(m), c) for m, c in ((s.prefix, "head"), (s.middle, "body"), (s.suffix, "tail"))]
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(head, tail, body)).otherwise(F.concat(tail, head, body))
    size = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return parts.select("doc_id", "n", "form", size("head").alias("prefix_chars"), size("body").alias("middle_chars"), output.alias("output"), "text")


def restored(output: Column, form: Column, s: Settings = Settings()) -> Column:
    """The text that a transformed one was made of, from the output and its form alone.

    Each sentinel stands once in such an output: no text that holds one is transformed,
    and one can't begin inside another.
    """
    before = lambda c, mark: F.substring_index(c, mark, 1)
    after = lambda c, mark: F.substring_index(c, mark, -1)
    body, rest = after(output, s.middle), before(output, s.middle)
    psm = F.concat(after(before(rest, s.suffix), s.prefix), body, after(rest, s.suffix))
    spm = F.concat(after(rest, s.prefix), body, after(before(rest, s.prefix), s.suffix))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The transformed texts and those restored from them, as SHA-256 digests."""
    back = restored(F.col("output"), F.col("form"), s)
    return transform(docs, s).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
