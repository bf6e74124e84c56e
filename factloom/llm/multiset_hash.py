"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (a non-empty line) hashes to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors modulo powers of two. The sum
does not depend on the order; a paragraph is inserted or deleted by adding or
subtracting its vector. The vector has two parts:

- 4 lanes modulo 2^62 from two independent 64-bit hashes, for equality;
- 60 lanes modulo 2^14 that count, bit by bit, a 64-bit hash of the paragraph,
  four lanes packed in a long, each with a spare bit that takes the carry. Read
  as 2 * count - paragraphs they are a sketch of the multiset with +1/-1 signs,
  so the squared distance of two fingerprints estimates the size of the
  multisets' difference. The number of paragraphs (modulo 2^14) goes with them.

All of it is built-in column functions: an array of paragraphs is folded inside
its row, so fingerprints need no shuffle. The likeness is an estimate with a
standard error of about 0.15 and holds up to 2^13 paragraphs a text; equality
holds at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE, PACKED = 4, 15
LANES = range(WIDE + PACKED)
M62 = (1 << 62) - 1
ONES = sum(1 << s for s in (0, 15, 30, 45))
M14 = 0x3FFF * ONES
#: Ranges of ids at most in which next documents are looked for.
BUCKETS = 10_000


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")


def _hashes(p: Column) -> Column:
    return F.struct(F.xxhash64(p).alias("h"), F.xxhash64(F.lit("wide"), p).alias("g"))


def _lane(x: Column, i: int) -> Column:
    """Lane i of the paragraph with these two hashes."""
    if i < WIDE:
        return F.xxhash64(x["h"], x["g"], F.lit(i)).bitwiseAND(F.lit(M62))
    return F.shiftrightunsigned(x["h"], i - WIDE).bitwiseAND(F.lit(ONES))


def _plus(a: Column, b: Column, i: int) -> Column:
    return (a + b).bitwiseAND(F.lit(M62 if i < WIDE else M14))


def _minus(a: Column, b: Column, i: int) -> Column:
    if i < WIDE:
        return (a - b).bitwiseAND(F.lit(M62))
    return _plus(a, (F.lit(M14) - b + F.lit(ONES)).bitwiseAND(F.lit(M14)), i)


def _lanes(of) -> Column:
    return F.struct(*[of(i).alias(f"l{i}") for i in LANES])


def vector(text: Column) -> Column:
    """The summed lanes of a text, a struct of longs; all zero without a paragraph."""
    hashed = F.transform(paragraphs(text), _hashes)
    zero = _lanes(lambda i: F.lit(0).cast("long"))
    return F.aggregate(hashed, zero, lambda a, x: _lanes(lambda i: _plus(a[f"l{i}"], _lane(x, i), i)))


def inserted(fp: Column, paragraph: Column) -> Column:
    """The vector with a paragraph added."""
    return _lanes(lambda i: _plus(fp[f"l{i}"], _lane(_hashes(paragraph), i), i))


def deleted(fp: Column, paragraph: Column) -> Column:
    """The vector with one occurrence of a paragraph taken away."""
    return _lanes(lambda i: _minus(fp[f"l{i}"], _lane(_hashes(paragraph), i), i))


def as_hex(fp: Column, n: Column) -> Column:
    parts = [F.lpad(F.lower(F.hex(fp[f"l{i}"])), 16, "0") for i in LANES]
    return F.concat(*parts, F.lpad(F.lower(F.hex(n.bitwiseAND(F.lit(0x3FFF)))), 4, "0"))


def signed(fp: Column, n: Column) -> Column:
    """The sketch's lanes with signs, as doubles."""
    packed = F.array(*[fp[f"l{i}"] for i in LANES[WIDE:]])
    each = F.flatten(F.transform(packed, lambda x: F.array(*[F.shiftright(x, s).bitwiseAND(F.lit(0x3FFF)) for s in (0, 15, 30, 45)])))
    return F.transform(each, lambda c: (2 * c - n).cast("double"))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """1 for equal fingerprints, else 1 - |a-b|^2 / (|a|^2 + |b|^2) of the signed
    lanes, from 0 to a little under 1: an estimate of the share of paragraphs (as
    multisets) that two texts have in common."""

    def square(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c)

    size = square(a) + square(b)
    far = square(F.zip_with(a, b, lambda x, y: x - y))
    return F.when(same, 1.0).when(size == 0, 0.0).otherwise(F.least(F.lit(0.999999), F.greatest(F.lit(0.0), 1 - far / size)))


def _bucket(id_: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at or below id_, by two short searches."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    told = lambda some: F.expr(f"array({','.join(f'{b}L' for b in some)})")
    coarse = F.size(F.filter(told(bounds[::step]), lambda b: b <= id_))
    fine = F.size(F.filter(F.slice(told(bounds), (coarse - 1) * step + 1, step), lambda b: b <= id_))
    return F.when(id_.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + fine)


def with_next(docs: DataFrame, carried: list[str], n_buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text and more) with the carried columns of the next document as
    next_<name>, by descending doc_id (ties by text, null ids last; after the last
    comes the first).

    The rows are shuffled once: ids fall into ranges between quantiles, and each
    range gets a copy of the first document of the range that follows.
    """
    spark = docs.sparkSession
    n = n_buckets or min(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = ",".join(str(i / n) for i in range(1, n))
    bounds = sorted(set(docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {20 * n})").alias("b")).first()["b"] or []))
    placed = docs.withColumn("bucket", _bucket(F.col("doc_id"), bounds))
    # one row a range: its highest id, and the range that this document follows
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()
    heads.sort(key=lambda r: r["bucket"])
    follows = [(r["bucket"], r["head"], heads[(i + 1) % len(heads)]["bucket"]) for i, r in enumerate(heads)]
    heads = spark.createDataFrame(follows, "bucket int, head long, into int")
    marked = placed.join(F.broadcast(heads), "bucket")  # at most BUCKETS rows
    home = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("into").alias("b"), F.lit(1).alias("copy"))
    dealt = marked.withColumn("at", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(home, copy)).otherwise(F.array(home))))
    w = Window.partitionBy("at.b").orderBy("at.copy", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    led = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).where("at.copy = 0")
    return led.drop("at", "bucket", "head", "into")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next per row. The edited text is the document's with its last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document's, by descending doc_id; after the last comes the first.

    Null texts count as empty; the empty text has the zero fingerprint. A table of
    one document is its own next. Documents with equal ids follow in order of their
    texts, a null id comes last. An empty table gives no rows. Other columns are
    not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    d = d.withColumns({"v": vector(F.col("text")), "n": F.size(paragraphs(F.col("text"))).cast("long")})
    both = with_next(d, ["text", "v", "n"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "v", "n", "next_v", "next_n")
    e = both.withColumns({"edited_v": vector(F.col("edited")), "edited_n": F.size(paragraphs(F.col("edited"))).cast("long")})
    e = e.withColumns({f"{x}s": signed(F.col(f"{x}v"), F.col(f"{x}n")) for x in ("", "edited_", "next_")})
    alike = lambda x: F.round(likeness(F.col("s"), F.col(f"{x}s"), F.col("v") == F.col(f"{x}v")), 6)
    return e.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("v"), F.col("n")).alias("fingerprint"),
        as_hex(F.col("edited_v"), F.col("edited_n")).alias("edited_fingerprint"),
        alike("edited_").alias("near_edited"),
        alike("next_").alias("near_next"),
    )
