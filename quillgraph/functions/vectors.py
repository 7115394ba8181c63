"""Vector expressions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def normalise(a: Column) -> Column:
    """Unit length; the zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def guard(a: Column, model: Column, wanted_model: str, dim: int) -> Column:
    """Why a vector may not enter an index: model, dim or finite; null if it may."""
    return F.when(model != wanted_model, F.lit("model")).when(F.size(a) != dim, F.lit("dim")).when(~finite(a), F.lit("finite"))


def bit_patterns(a: Column) -> Column:
    """Floats as unsigned 32-bit patterns: for a total order of vectors that does not depend on arithmetic.

    From sign, exponent and fraction of the finite value; zeros keep their sign.
    """

    def bits(x):
        x = x.cast("double")
        size = F.abs(x)
        power = F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))).cast("int")
        power = F.when(F.pow(F.lit(2.0), power.cast("double")) > size, power - 1).when(F.pow(F.lit(2.0), (power + 1).cast("double")) <= size, power + 1).otherwise(power)
        normal = (power + 127).cast("long") * (1 << 23) + ((size / F.pow(F.lit(2.0), power.cast("double")) - 1) * (1 << 23)).cast("long")
        small = (size / F.lit(2.0**-149)).cast("long")
        negative = (x < 0) | (x.cast("string") == "-0.0")
        return F.when(size == 0, F.lit(0).cast("long")).when(power < -126, small).otherwise(normal) + F.when(negative, F.lit(1 << 31)).otherwise(F.lit(0))

    return F.transform(a, bits)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: x != "")


def hash_embedding(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, bucket, weight): the nonzero entries of signed hashing embeddings, L2-normalised.

    Per token of sha2: bucket is its first 8 hex digits modulo dim, and the 17th digit's parity the sign.
    """
    tok = df.select(key, F.explode(tokens(F.col(text))).alias("token"))
    tok = tok.groupBy(key, "token").count()  # repeats meet here, before hashing
    h = F.sha2(F.col("token"), 256)
    bucket = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = tok.select(key, bucket.alias("bucket"), (sign * F.col("count")).alias("w")).groupBy(key, "bucket").agg(F.sum("w").alias("w")).where("w <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum((F.col("w") * F.col("w")).cast("double"))).alias("size"))
    return sums.join(norms, key).select(key, "bucket", (F.col("w") / F.col("size")).alias("weight"))
