"""Mix sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document draws u in [0, 1) from its id and gets the key u^(1/quality). Within a source
the documents are taken by falling key until the word budget is met. Whole epochs come first:
a target of 1.3 times its source takes every document once and then 0.3 of the source by key.

The order within a source is never sorted as a whole. A histogram of words over key bins finds
the one bin in which a source's budget runs out; documents above it are taken, documents below
it are not, and only those in it are put in exact order. A hot source therefore costs one
pre-aggregated histogram and a sort of about 1/4096 of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, word_count
from sparkloom.session import materialise

KEY_BINS = 4096
_SYMBOLS = "%&*#$|!=<>{}[]~^"


def symbol_quality(text: Column) -> Column:
    """Quality weight from the share of symbol characters: 1, 0.5 (2 % or more) or 0.25 (10 % or more).

    Null and empty texts weigh 1; they hold no words, so it does not matter.
    """
    length = F.greatest(F.length(text), F.lit(1))
    share = 1 - F.length(F.translate(text, _SYMBOLS, "")) / length
    return F.when(share >= 0.1, 0.25).when(share >= 0.02, 0.5).otherwise(1.0)


def draw(doc_id: Column, seed: str) -> Column:
    """u in [0, 1): 48 bits of an md5, so that other engines can repeat it."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code-point order, null last, take the weights in turn. The targets share
    ``share`` of all sizes by weight, and none exceeds ``max_epochs`` times its source: the
    excess goes to the others by weight. That is a water level: sorted by cap / weight, the
    first sources are full and the others get weight x level. One row per source meets in
    one task.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighted = sizes.withColumns({
        "w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")),
        "cap": F.col("source_size") * F.lit(float(max_epochs)),
    }).withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - full) / F.sum("w").over(after)
    return (
        weighted.withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"])
        # no open source is left when the share reaches the sum of the caps: all are full
        .withColumn("target", F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap"))))
        .select("source", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    quality: Column | None = None,
) -> DataFrame:
    """All columns of ``docs`` and ``__mix``, a struct (size, source_size, target, taken).

    ``docs`` has doc_id, text and source; other columns pass through whatever their names.
    ``taken`` is the number of words the mix takes of the document: whole epochs times its
    size, plus its size if the fractional selection reaches it, plus a part of it for the
    document at which the source's budget ends, so each source gives its target rounded to
    a word. Null texts have size 0; a null source is a source; ids may be null or repeated
    (equal ids draw equal keys, ties go to the smaller id, then by text hash); an empty
    table gives an empty result; sources without words have target 0.
    """
    quality = symbol_quality(F.col("text")) if quality is None else quality
    key = F.pow(draw(F.col("doc_id"), seed), F.lit(1.0) / quality)
    keyed = docs.withColumns({"__key": key})
    keyed = keyed.withColumn("__bin", F.least(F.floor(F.col("__key") * KEY_BINS), F.lit(KEY_BINS - 1)).cast("int"))

    histogram = keyed.groupBy("source", "__bin").agg(F.sum(word_count(F.col("text"))).alias("words"))
    sizes = histogram.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs).withColumns({
        "budget": F.floor(F.col("target") + 0.5).cast("bigint"),
    }).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("bigint")
    ).withColumn("budget", F.col("budget") - F.col("epochs") * F.col("source_size"))

    by_key = Window.partitionBy("source").orderBy(F.col("__bin").desc())
    crossing = (
        histogram.withColumn("upto", F.sum("words").over(by_key))
        .join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .filter(F.col("upto") >= F.col("budget"))
        .groupBy("source")
        .agg(
            F.max(F.struct("__bin", (F.col("budget") - F.col("upto") + F.col("words")).alias("left"))).alias("__cross"),
            F.max(F.struct("source_size", "target", "epochs")).alias("__plan"),
        )
        .select(F.col("source").alias("__source"), "__cross", "__plan")
    )
    # one row per source; stored, so its real size decides whether it is broadcast and the texts stay in place
    crossing = materialise(crossing, "mix-plan")
    planned = keyed.join(crossing, F.col("source").eqNullSafe(F.col("__source")))
    size = word_count(F.col("text"))

    def with_taken(rows: DataFrame, extra: Column) -> DataFrame:
        return rows.withColumn("__mix", F.struct(
            F.col("__size").alias("size"), F.col("__plan.source_size").alias("source_size"), F.col("__plan.target").alias("target"),
            (F.col("__plan.epochs") * F.col("__size") + extra).alias("taken"),
        )).select(*[F.col(f"`{c}`") for c in docs.columns], "__mix")

    outside = planned.filter(F.col("__bin") != F.col("__cross.__bin")).withColumn("__size", size)
    inside = planned.filter(F.col("__bin") == F.col("__cross.__bin")).withColumn("__size", size)
    exact = Window.partitionBy("source").orderBy(
        F.col("__key").desc(), F.col("doc_id").asc_nulls_last(), F.xxhash64("text")
    ).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__cross.left") - F.coalesce(F.sum("__size").over(exact), F.lit(0))
    return with_taken(outside, F.when(F.col("__bin") > F.col("__cross.__bin"), F.col("__size")).otherwise(0)).unionAll(
        with_taken(inside, F.greatest(F.lit(0), F.least("__size", left)))
    )


def mixed_documents(mixed: DataFrame) -> DataFrame:
    """The documents of a mix: one row per whole copy, and the cut last copy of a document.

    A cut copy holds the first words, joined by one space. ``n_chars`` follows the text.
    """
    columns = [c for c in mixed.columns if c != "__mix"]
    size, taken = F.col("__mix.size"), F.col("__mix.taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    rest = (taken - whole * size).cast("int")
    copies = mixed.withColumns({"__whole": whole, "__rest": rest})
    copies = copies.filter((F.col("__whole") > 0) | (F.col("__rest") > 0)).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__whole") + (F.col("__rest") > 0).cast("int")))
    )
    is_cut = F.col("__copy") > F.col("__whole")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.col("__rest"), F.lit(0))), " ")
    changed = {"text": F.when(is_cut, head).otherwise(F.col("text"))}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(is_cut, F.length(head)).otherwise(F.col("n_chars")).cast(mixed.schema["n_chars"].dataType)
    return copies.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in columns])
