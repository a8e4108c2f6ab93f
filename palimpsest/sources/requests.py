"""Sources: documents, pages, conversations and explicit segment lists as request rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<id:string,text:string>>"
#: Column, type and default of a request row.
REQUEST: tuple[tuple[str, str, object], ...] = (
    ("request_id", "string", None), ("request_kind", "string", "chat"), ("scope", "string", "session"), ("session_key", "string", None), ("placeholder_namespace", "string", None),
    ("text_pii_enabled", "boolean", True), ("attachments_present", "boolean", False), ("face_status", "string", None), ("face_count", "int", None),
    ("mcp_sources", "array<string>", None), ("destination_model", "string", None), ("cached_decision", "string", None), ("cached_route", "string", None), ("segments", SEGMENTS, None),
)


def requests(df: DataFrame) -> DataFrame:
    """Request rows from whatever of the request columns ``df`` has; the rest gets defaults. Null segments are none, null texts empty."""
    columns = []
    for name, kind, default in REQUEST:
        value = F.col(name).cast(kind) if name in df.columns else F.lit(default).cast(kind)
        if default is not None and name in df.columns:
            value = F.coalesce(value, F.lit(default))
        if name == "segments":
            value = F.transform(F.coalesce(value, F.array().cast(SEGMENTS)), lambda s: F.struct(s.id.alias("id"), F.coalesce(s.text, F.lit("")).alias("text")))
        columns.append(value.alias(name))
    return df.select(*columns)


def _one(id_: Column, text: Column) -> Column:
    return F.array(F.struct(id_.cast("string").alias("id"), text.alias("text")))


def documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One request, with one segment, per document; request scope, so nothing sticks to a session."""
    return requests(df.select(F.col(key).cast("string").alias("request_id"), F.lit("request").alias("scope"), _one(F.lit("document"), F.col(text)).alias("segments"), *[c for c in ("face_status", "face_count") if c in df.columns]))


def pages(df: DataFrame) -> DataFrame:
    """One request per web page, its markup reduced to text."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return documents(df.select("page_id", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text")), "page_id")


def conversations(df: DataFrame) -> DataFrame:
    """One request per turn; the conversation is the session, the turn its order."""
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    one = requests(df.select(key.alias("request_id"), F.sha2(F.col("conv_id").cast("string"), 256).alias("session_key"), _one(F.col("turn"), F.col("text")).alias("segments"), "turn"))
    return one.withColumn("turn", F.substring_index("request_id", "-", -1).cast("long"))


def segments(requests_: DataFrame) -> DataFrame:
    """One row per segment, in order."""
    return requests_.select("request_id", F.posexplode("segments").alias("pos", "s")).select("request_id", "pos", F.col("s.id").alias("segment_id"), F.col("s.text").alias("text"))


def malformed(requests_: DataFrame) -> DataFrame:
    """Requests whose segment ids are not unique, or not 1 to 128 characters of the allowed alphabet."""
    ids = F.transform("segments", lambda s: s.id)
    bad = F.exists(ids, lambda i: i.isNull() | ~i.rlike(r"^[A-Za-z0-9_.:-]{1,128}$")) | (F.size(F.array_distinct(ids)) != F.size(ids))
    return requests_.where(bad)
