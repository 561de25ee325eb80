"""Explicit schemas of the entities; nothing is inferred."""

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "tinyint": T.ByteType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _S(fields: str) -> T.StructType:
    """A schema of simple types and arrays of them, which needs no session."""
    pairs = (f.split(" ") for f in fields.split(", "))
    kind = lambda k: T.ArrayType(_SIMPLE[k[6:-1]]) if k.startswith("array<") else _SIMPLE[k]
    return T.StructType([T.StructField(n, kind(k)) for n, k in pairs])


DOCS = _S("workspace_id string, doc_id bigint, url string, split_ids array<bigint>, summary_ids array<bigint>")
SPLITS = _S("workspace_id string, split_id bigint, doc_id bigint, seq_id int, text string, token_len bigint, summary_ids array<bigint>, embedding array<float>, model_id bigint")
SUMMARIES = _S("workspace_id string, summary_id bigint, doc_id bigint, split_id bigint, split_seq_id int, text string, token_len bigint, centrality float, embedding array<float>, model_id bigint")
RANK = _S("index int, rank int, score float, text string")
#: Change log: kinds are those in KIND.
LOG = _S("segment int, seq bigint, kind tinyint, doc_id bigint, entity_id bigint, split_ids array<bigint>, summary_ids array<bigint>, text string")
HEADER = _S("id string, type tinyint, status tinyint, error_code int, error_message string, request_ts bigint, response_ts bigint")
LEGACY_FILTER = _S("embed_id bigint, doc_id bigint, user_uuid string")
LEGACY_EMBEDDINGS = _S("embedding_id bigint, embedding_type tinyint, embedding array<float>, model_id bigint")

KIND = {"doc": 1, "split": 2, "summary": 3, "delete": 4}
SEARCH_MODE = {"split": 1, "summary": 2, "both": 3}
STATUS = {"success": "Success", "error": "Error", "not_found": "NotFound"}
#: Request types of the dispatch table.
REQUEST = {"insert": 1, "query": 2, "retrieve": 3, "delete": 6, "rerank": 7, "health": 9, "unknown": 10}
