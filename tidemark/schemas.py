"""The fixed schemas of all tables. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()
VECTOR = T.ArrayType(T.FloatType())


def _struct(spec: list[tuple[str, T.DataType, bool]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in spec])


CHUNK = _struct([("id", _S, False), ("doc_id", _S, False), ("doc_path", _S, False), ("category", _S, False), ("category_text", _S, False), ("content", _S, False), ("chunk_index", _I, False), ("total_chunks", _I, False)])
DOCUMENTS = T.StructType(CHUNK.fields + _struct([("vector", VECTOR, True), ("content_hash", _S, False), ("embedding_status", _S, False), ("embedding_error", _S, True), ("embedding_version", _I, False), ("embedded_at", _TS, True), ("index_status", _S, False), ("index_version", _I, False)]).fields)
EMBEDDINGS = _struct([("id", _S, False), ("embedder_id", _S, False), ("content_hash", _S, False), ("embedded_at", _TS, False), ("vector", VECTOR, True)])
CACHE = _struct([("content_hash", _S, False), ("embedder_id", _S, False), ("created_at", _TS, False), ("vector", VECTOR, True)])
META = _struct([("key", _S, False), ("value", _S, False), ("updated_at", _TS, False)])
HIT = _struct([("id", _S, False), ("score", _D, False), ("source", _S, False)])
TEXT_RESULT = _struct([("score", _D, False), ("id", _S, False), ("category", _S, True), ("path", _S, True), ("snippet", _S, True)])
VECTOR_RESULT = _struct([("score", _D, False), ("id", _S, False), ("category", _S, True), ("path", _S, True), ("content", _S, True)])
ELEMENT = _struct([("type", _S, True), ("text", _S, True)])
EXTRACT = _struct([("content", _S, True), ("metadata", _struct([("file_path", _S, True), ("file_name", _S, True), ("file_size", _L, True), ("num_pages", _I, True), ("elements", T.ArrayType(ELEMENT), True), ("error", _S, True)]), True)])
POSTINGS = _struct([("term", _S, False), ("id", _S, False), ("tf", _I, False), ("dl", _I, False), ("positions", T.ArrayType(_I), False)])
VALIDATION = T.MapType(_S, _struct([("passed", T.BooleanType(), False), ("issues", T.ArrayType(_S), False)]))

STATUSES = ("new", "in_progress", "ready", "error")
