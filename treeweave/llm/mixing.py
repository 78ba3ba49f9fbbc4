"""Mix sources to target weights by systematic sampling.

Every document of a source is expected in the mix `target / source size` times. The expected copies are summed up along
the source, largest documents first, one random offset per source is added, and a document is emitted once per whole
number that the sum crosses at it. As the sum runs in order of size, the words taken differ from the target by less
than the size of the largest document of the source, and no document is taken more than the rounded-up number of times.

Only column expressions. Positions come from `ordering.with_running`, which range-partitions a source over many tasks,
so a source that holds a third of all rows is no single group. Figures per source are one row per source; the level at
which targets stop at their limit is found from running sums over sources and reaches the driver as one number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from treeweave.llm.support import fresh, word_count
from treeweave.operators.ordering import with_running
from treeweave.session import pin

SHARE = 1.5
WEIGHTS = (3, 1, 2)
MOST_COPIES = 2
SEED = "mix"


def _source_key(source: Column) -> Column:
    """Text that orders sources by code point and a null source after all others."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def source_targets(
    sizes: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS, most_copies: int = MOST_COPIES
) -> DataFrame:
    """Targets of sources from rows (`key`, `source_size`): adds `target`.

    Sources in order of `key` weigh `weights`, over and over, and share `share` times all sizes. A target stops at
    `most_copies` times its source's size and the rest shares the excess by weight, until no target is above.
    """
    ranked = with_running(sizes, [], [F.col("key")], number="position")
    turn = ((F.col("position") - 1) % len(weights) + 1).cast("int")
    weighted = ranked.select(
        "key", "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
        (F.col("source_size") * F.lit(most_copies)).cast("double").alias("limit"),
    ).withColumn("full_at", F.col("limit") / F.col("weight"))
    filled = with_running(
        weighted, [], [F.col("full_at"), F.col("key")], number="turn", sums={"limits": "limit", "weights": "weight"}
    )
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, weight = share * (whole["size"] or 0), whole["weight"] or 0.0
    # Sources fill up in order of limit per weight; the first that does not fill up sets the level for all after it.
    level = (F.lit(total) - (F.col("limits") - F.col("limit"))) / (F.lit(weight) - F.col("weights") + F.col("weight"))
    found = filled.select("turn", "limit", "weight", level.alias("level")).where(F.col("limit") > F.col("weight") * F.col("level"))
    row = found.agg(F.min_by("level", "turn").alias("level")).first()
    reach = F.lit(float("inf") if row["level"] is None else row["level"])
    return weighted.select("key", "source_size", F.least(F.col("limit"), F.col("weight") * reach).alias("target"))


def _row_hashes(docs: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two hashes that together tell rows apart by `columns`."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    parts = [F.map_entries(F.col(f"`{c}`")) if isinstance(kinds[c], MapType) else F.col(f"`{c}`") for c in columns]
    # A null leaves a hash as it is, so where the nulls are counts too.
    nulls = [F.isnull(p) for p in parts]
    return [F.xxhash64(F.lit(salt), *parts, *nulls) for salt in ("one", "two")]


def mix_plan(
    docs: DataFrame,
    share: float = SHARE,
    weights: Sequence[float] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per input row: `doc_id`, `source`, `size`, `source_size`, `target`, `copies`, `taken` (words), and two hashes.

    `row_hash` and `row_check` tell rows apart by `row_columns`, the three named columns if none are given.

    Size is the number of words; null and empty texts have size 0 and count as documents of their source. A null source
    is a source of its own. Equal rows are told apart only by their place in the order, so the multiset of results is
    the same in every run. Other columns are not read, so their names do not matter. An empty table gives no rows.
    """
    row_hash, row_check = _row_hashes(docs, row_columns or [id_col, text_col, source_col])
    narrow = pin(docs.select(
        F.col(id_col).alias("doc_id"),
        row_hash.alias("row_hash"),
        row_check.alias("row_check"),
        F.col(source_col).alias("source"),
        _source_key(F.col(source_col)).alias("key"),
        word_count(F.col(text_col)).alias("size"),
    ))
    targets = source_targets(narrow.groupBy("key").agg(F.sum("size").alias("source_size")), share, weights, most_copies)
    placed = with_running(
        narrow, ["key"], [F.col("size").desc(), F.col("doc_id"), F.col("row_hash"), F.col("row_check")], number="position"
    )
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Fixed rule of the offset, the same in the SQL of the checks: 52 bits of a digest as a fraction.
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("key"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))

    def crossed(position: Column) -> Column:
        return F.floor(position * F.col("each") + F.col("offset"))

    return (
        placed.join(targets, "key")
        .withColumn("each", each)
        .withColumn("offset", offset)
        .withColumn("copies", (crossed(F.col("position")) - crossed(F.col("position") - 1)).cast("int"))
        .select(
            "doc_id", "row_hash", "row_check", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        )
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of `docs`, all columns, each as often as `mix_plan` says.

    Rows that are equal in all columns are one row with the copies of all of them, so rows meet their copies in one shuffle.
    """
    plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, row_columns=docs.columns, **options)
    row_hash, row_check, copies, copy = (fresh(docs.columns, f"_{c}") for c in ("row_hash", "row_check", "copies", "copy"))
    first, second = _row_hashes(docs, docs.columns)
    once = docs.withColumns({row_hash: first, row_check: second}).dropDuplicates([row_hash, row_check])
    wanted = plan.groupBy(F.col("row_hash").alias(row_hash), F.col("row_check").alias(row_check)).agg(
        F.sum("copies").cast("int").alias(copies)
    ).where(F.col(copies) > 0)
    return (
        once.join(wanted, [row_hash, row_check])
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
