"""Checksums, stable ids and hashed features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a concept.
CONCEPTS = {
    "accelerated-compute": ("accelerator", "accelerators", "cuda", "gpu", "gpus", "hpc", "kernel", "kernels", "metal", "onnx", "parallel", "rocm", "tensor", "tensors", "vectorization"),
    "rag-retrieval": ("chunk", "chunking", "citation", "citations", "embedding", "embeddings", "generation", "index", "indexing", "llm", "rag", "retrieval", "search", "semantic", "vector", "vectors"),
    "backend-systems": ("api", "backend", "database", "postgres", "rust", "service", "sql", "sqlx"),
    "frontend-ui": ("frontend", "react", "typescript", "ui", "vite", "web"),
    "profile-evidence": ("resume", "experience", "project", "projects", "skill", "skills"),
}


def checksum(x: Column) -> Column:
    return F.sha2(x, 256)


def feature_index(feature: Column, dimension: int = 384) -> Column:
    """The first eight bytes of the digest, big-endian, modulo the dimension."""
    return (F.conv(F.substring(F.sha2(feature, 256), 1, 16), 16, 10).cast("decimal(20,0)") % dimension).cast("int")


def feature_sign(feature: Column) -> Column:
    """1 where the low bit of the ninth byte is set, else -1."""
    odd = F.conv(F.substring(F.sha2(feature, 256), 17, 2), 16, 10).cast("int").bitwiseAND(1)
    return F.when(odd == 1, F.lit(1)).otherwise(F.lit(-1))


def stable_uuid(key: Column) -> Column:
    """A UUID from the first sixteen digest bytes, of version 5 and the standard variant."""
    h = F.sha2(key, 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def concept(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, tokens in CONCEPTS.items():
        out = F.when(token.isin(*tokens), F.lit(name)).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty ones and ones without length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0)))
