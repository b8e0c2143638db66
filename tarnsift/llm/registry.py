"""The operators' queries, and SQL for those that SQL can express."""

from . import embeddings, langid, licenses, media, mixing, neardup, packing, pii, quality, secrets

QUERIES = {
    "op1_language": langid.query,
    "op2_personal": pii.query,
    "op3_media": media.query,
    "op4_neardup": neardup.query,
    "op5_mixing": mixing.query,
    "op6_secrets": secrets.query,
    "op7_embeddings": embeddings.query,
    "op8_licenses": licenses.query,
    "op9_packing": packing.query,
    "op10_quality": quality.query,
}

SQL: dict[str, str] = {
    "op5_mixing": mixing.SQL,
    "op7_embeddings": embeddings.SQL,
    "op8_licenses": licenses.SQL,
}
