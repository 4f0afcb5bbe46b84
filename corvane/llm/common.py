"""What the operators of this subpackage share: session settings, word rules, bounded joins."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of bytes other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
#: For bytes.translate: A-Z to a-z, everything else as it is.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z and no other letter. Texts of ASCII alone, as many bytes as characters, take the faster function."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def named(name: str) -> Column:
    """A column by its plain name, which may hold dots and other signs."""
    return F.col("`" + name.replace("`", "``") + "`")


def ident_type(docs: DataFrame, name: str) -> str:
    """Identifiers are whole numbers (kept as long) or anything else (kept as string)."""
    return "long" if docs.schema[name].dataType.typeName() in ("byte", "short", "integer", "long") else "string"


def ident(docs: DataFrame, name: str) -> Column:
    return named(name).cast(ident_type(docs, name))


def texts_of(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(named(name).cast("string"), F.lit(""))


def word_count(column: Column) -> Column:
    """Native count of words; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ready(spark: SparkSession) -> SparkSession:
    """The cluster names the shared folder for checkpoints; only a local master (tests) may do without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corvane-checkpoint-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows go to the shared folder, so a lost executor costs nothing that lies before."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: Column, splitters: list[str]) -> Column:
    """Number of splitters at or below a string key, by binary search inside the expression."""
    if not splitters:
        return F.lit(0)
    bounds = F.array(*[F.lit(s) for s in splitters])
    steps = max(1, len(splitters).bit_length())
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi")),
        lambda at, _: F.when(at.lo >= at.hi, at).otherwise(
            F.when(
                F.element_at(bounds, (F.floor((at.lo + at.hi) / 2) + 1).cast("int")) <= key,
                F.struct((F.floor((at.lo + at.hi) / 2) + 1).cast("int").alias("lo"), at.hi.alias("hi")),
            ).otherwise(F.struct(at.lo.alias("lo"), F.floor((at.lo + at.hi) / 2).cast("int").alias("hi")))
        ),
    )
    return found.lo


def sampled_keys(rows: DataFrame, key: Callable[[DataFrame], DataFrame], buckets: int, per_bucket: int = 24) -> list[tuple]:
    """Sorted keys of a random sample of about buckets * per_bucket rows (bounded: at most four times that reach the
    driver). key makes a frame of keys of rows; only sampled rows go through it."""
    n = rows.count()
    wanted = buckets * per_bucket
    some = key(rows if n <= wanted else rows.sample(wanted / n, seed=11))
    return sorted(tuple(r) for r in some.limit(4 * wanted).collect() if r[0] is not None)


def sampled_splitters(rows: DataFrame, key: Callable[[DataFrame], DataFrame], buckets: int, per_bucket: int = 24) -> list[str]:
    """Splitters between equal shares of a sample of keys."""
    found = [k[0] for k in sampled_keys(rows, key, buckets, per_bucket)]
    if not found:
        return []
    return sorted({found[len(found) * i // buckets] for i in range(1, buckets)})


def bounded(small: DataFrame, limit: int = 50_000, most_bytes: int = 16 << 20) -> DataFrame | None:
    """small, marked for broadcast, if it has at most limit rows and most_bytes of content; else None."""
    rows, size = small.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(small) if rows <= limit and (size or 0) <= most_bytes else None


def attach(big: DataFrame, small: DataFrame, on: str, salt_by: Column, limit: int = 50_000, salts: int = 32) -> DataFrame:
    """Left join to a table that has one row for each null-safe key: broadcast if small is proven so, else salted on both sides, so a hot key spreads."""
    key = f"_{on}_key"
    right = small.withColumnRenamed(on, key)
    if (near := bounded(right, limit)) is not None:
        return big.join(near, big[on].eqNullSafe(near[key]), "left").drop(key)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, left[on].eqNullSafe(right[key]) & (left["_salt"] == right["_salt_r"]), "left").drop(key, "_salt", "_salt_r")


def join_frequent(rows: DataFrame, groups: DataFrame, key: str, times: str, share: int = 200) -> DataFrame:
    """Inner join to one row for each key, where times says how often rows have it: keys of more than 1 / share of all
    rows (so at most share keys) meet their rows by broadcast, the others by shuffle."""
    total = groups.agg(F.sum(times)).first()[0] or 0
    often = F.col(times) * share > total
    near = F.broadcast(groups.where(often).drop(times))
    far = rows.join(near.select(key), key, "left_anti").join(groups.where(~often).drop(times), key)
    return rows.join(near, key).unionByName(far)
