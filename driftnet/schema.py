"""Schemas of the catalogue's tables. Readers and writers name them; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "floats": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


CATALOG = _struct(
    "id:long path:string filename:string ext:string size_bytes:long mtime:double content_hash:string status:string error_reason:string "
    "retry_count:int last_attempt:double first_seen:double last_seen:double deleted_at:double"
)
EMBEDDING = _struct("content_hash:string extracted_text:string source_kind:string model:string char_count:long created_at:double")
VECTOR = _struct("content_hash:string embedding:floats")
TIMING = _struct("id:long source_kind:string stage:string seconds:double bytes:long at:double")
WALK = _struct("path:string size_bytes:long mtime:double renamed:int")
CITY = _struct("lat:double lon:double name:string")
TABLES = {"file_catalog": CATALOG, "file_embedding": EMBEDDING, "vec_embedding": VECTOR, "enrich_timing": TIMING}
