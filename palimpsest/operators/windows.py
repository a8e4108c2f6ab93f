"""Text windows for models: overlapping cuts with unique ownership, token windows, BIO decoding, and memoised inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import hmac_sha256
from ..functions.spans import SPAN, let, span

#: Default window and overlap, in characters.
SIZE, OVERLAP = 900_000, 10_000
SPAN_FIELDS = ("entity_type", "start", "end", "score", "source")
SPAN_ARROW = pa.list_(pa.struct(list(zip(SPAN_FIELDS, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()), strict=True))))


def text_windows(segments: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """``segments`` exploded to windows: ``window_start``, ``window_text``, ``owned_start``, ``owned_end``; every character is owned once."""
    n = F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(size)))
    df = segments.withColumn("owned_start", F.explode(starts)).withColumn("owned_end", F.least(n, F.col("owned_start") + size))
    whole = n <= size
    begin = F.when(whole, 0).otherwise(F.greatest(F.lit(0), F.col("owned_start") - overlap))
    end = F.when(whole, n).otherwise(F.least(n, F.col("owned_end") + overlap))
    return df.withColumn("window_start", begin).withColumn("window_text", F.substr(F.col(text), begin + 1, end - begin))


def owned(spans: Column, window_start: Column, owned_start: Column, owned_end: Column) -> Column:
    """Spans of a window moved to text offsets; only those whose midpoint the window owns."""
    moved = F.transform(spans, lambda s: s.withField("start", s.start + window_start).withField("end", s.end + window_start))
    middle = lambda s: F.floor((s.start + s.end) / 2)
    return F.filter(moved, lambda s: (middle(s) >= owned_start) & (middle(s) < owned_end))


def token_windows(offsets: Column, length: Column, window: int = 480, overlap: int = 64) -> Column:
    """``array<struct<start, end>>`` of windows of at most ``window`` tokens over token ``offsets`` (array<struct<start, end>>), covering all characters."""
    step = window - overlap

    def cut(tokens: Column) -> Column:
        n = F.size(tokens)
        last = F.greatest(F.ceil((n - window) / step).cast("int"), F.lit(0)) * step

        def one(i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.get(tokens, i).start)
            end = F.when(i + window >= n, length).otherwise(F.get(tokens, i + window).start)
            return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

        whole = F.array(F.struct(F.lit(0).alias("start"), length.cast("int").alias("end")))
        return F.when(n <= window, whole).otherwise(F.transform(F.sequence(F.lit(0), last, F.lit(step)), one))

    return let(offsets, cut)


def winning(probabilities: Column, labels: list[str]) -> Column:
    """The most probable label (the first of ``labels`` on ties) and its probability; labels that are missing, or not normalised, fail."""
    values = F.array(*[F.element_at(probabilities, label) for label in labels])
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)) | (F.size(probabilities) != len(labels)) | (F.abs(total - 1) > max(0.01, len(labels) * 0.0001))
    ranked = F.array(*[F.struct((-F.element_at(probabilities, label)).alias("p"), F.lit(i).alias("i"), F.lit(label).alias("label")) for i, label in enumerate(labels)])
    top = F.array_min(ranked)
    good = F.struct(top.label.alias("label"), (-top.p).alias("score"))
    return F.when(bad, F.raise_error(F.lit("class probabilities are invalid")).cast("struct<label:string,score:double>")).otherwise(good)


def bio_spans(tokens: Column, mapping: dict[str, str], source: str) -> Column:
    """Spans of BIO-labelled ``tokens`` (array<struct<start, end, label, score>>).

    Whether a token goes on with the span before it can be told from the token before alone: an I- token does, right after a token of the
    same name that ends no later than it begins. So spans open and close at places that are found in one pass, and long texts cost their length.
    """
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    name = lambda t: F.substr(t.label, F.lit(3))
    labelled = lambda t: (t.label != "O") & (t.start != t.end)

    def decoded(all_: Column) -> Column:
        def goes_on(i: Column) -> Column:
            t, p = F.get(all_, i), F.get(all_, i - 1)
            on = labelled(t) & labelled(p) & t.label.startswith("I-") & (name(t) == name(p)) & F.element_at(table, name(t)).isNotNull() & (p.end <= t.start)
            return F.coalesce((i > 0) & on, F.lit(False))

        places = F.transform(all_, lambda _, i: i)
        opens = F.filter(places, lambda i: labelled(F.get(all_, i)) & ~goes_on(i))
        closes = F.filter(places, lambda i: labelled(F.get(all_, i)) & ~goes_on(i + 1))

        def one(a: Column, z: Column) -> Column:
            score = F.array_max(F.transform(F.slice(all_, a + 1, z - a + 1), lambda t: t.score))
            return span(F.element_at(table, name(F.get(all_, a))), F.get(all_, a).start.cast("int"), F.get(all_, z).end.cast("int"), score.cast("double"), source)

        return F.zip_with(opens, closes, one)

    return let(tokens, decoded)


def memoised(windows: DataFrame, infer: Callable[[list[str]], list[list[tuple[str, int, int, float, str]]]], namespace: str = "", text: str = "window_text", key: bytes = b"window-cache") -> DataFrame:
    """``windows`` with ``window_hash`` and ``spans``: each distinct window text is inferred once, and joined back by its keyed digest, which says nothing about the text without the key."""
    keyed = windows.withColumn("window_hash", hmac_sha256(key, F.concat_ws("\x1f", F.lit(namespace), F.col(text))))
    distinct = keyed.groupBy("window_hash").agg(F.first(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[dict(zip(SPAN_FIELDS, h, strict=True)) for h in hits] for hits in infer(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, SPAN_ARROW)], names=["window_hash", "spans"])

    found = distinct.mapInArrow(run, f"window_hash string, spans array<{SPAN}>")
    return keyed.join(found, "window_hash")


def adaptive(texts: list[str], call: Callable[[str], list[tuple[str, int, int, float, str]]], too_large: type[Exception], size: int = 1024, overlap: int = 128, max_calls: int = 1000) -> list[list[tuple[str, int, int, float, str]]]:
    """A bounded number of model calls over windows of ``size`` characters; a window that the model finds too large is halved.

    For use inside ``SpanModel.find`` or ``memoised``: the budget is shared by the texts of one call.
    """
    calls, out = 0, []
    for text in texts:
        best: dict[tuple[str, int, int, str], float] = {}
        pending = [(i, min(len(text), i + size)) for i in range(0, max(len(text), 1), size - overlap)]
        while pending:
            a, b = pending.pop()
            calls += 1
            if calls > max_calls:
                raise RuntimeError("the call budget is used up")
            try:
                hits = call(text[a:b])
            except too_large:
                if b - a <= 2 * overlap:
                    raise
                middle = (a + b) // 2
                pending += [(a, min(b, middle + overlap // 2)), (max(a, middle - overlap // 2), b)]
                continue
            for e, s, t, score, source in hits:
                key = (e, a + s, a + t, source)
                best[key] = max(best.get(key, 0.0), score)
        out.append([(e, s, t, score, source) for (e, s, t, source), score in sorted(best.items(), key=lambda x: (x[0][1], x[0][2], x[0][0], x[0][3]))])
    return out


def budgeted(
    windows: DataFrame, call: Callable[[str], list[tuple[str, int, int, float, str]]], max_calls: int, request: str = "request_id", order: tuple[str, ...] = ("window_start",), text: str = "window_text",
    too_large: type[Exception] = ValueError, overlap: int = 128,
) -> DataFrame:
    """``windows`` with ``spans`` and ``error``: all windows of a request share ``max_calls`` calls of a model, in their ``order``.

    A window that the model finds too large is halved, and each part is a call. A request that needs more calls than it has, and one
    with a window that cannot be halved, gets an error value on all its windows, and no spans; other requests are not touched. A request's windows beyond
    its budget are never gathered: that they are there is enough.
    """
    place = F.row_number().over(Window.partitionBy(request).orderBy(*order))
    ranked = windows.withColumn("__place", place)
    asked = ranked.select(F.col(request).alias("request"), "__place", F.coalesce(text, F.lit("")).alias("text")).where(F.col("__place") <= max_calls + 1)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("__place")
        calls, error, rows = group.num_rows if group.num_rows > max_calls else 0, None, []
        for t in group.column("text").to_pylist():
            best: dict[tuple[str, int, int, str], float] = {}
            parts = [(0, len(t))]
            while parts and error is None:
                a, b = parts.pop()
                calls += 1
                if calls > max_calls:
                    error = "model_call_budget"
                    break
                try:
                    hits = call(t[a:b])
                except too_large:
                    if b - a <= 2 * overlap:
                        error = "model_input_too_large"
                    middle = (a + b) // 2
                    parts += [(max(a, middle - overlap // 2), b), (a, min(b, middle + overlap // 2))]
                    continue
                for e, s, z, score, source in hits:
                    at = (e, a + s, a + z, source)
                    best[at] = max(best.get(at, 0.0), score)
            rows.append([dict(zip(SPAN_FIELDS, (e, s, z, score, source), strict=True)) for (e, s, z, source), score in sorted(best.items(), key=lambda x: (x[0][1], x[0][2], x[0][0], x[0][3]))])
            if error:
                break
        n = group.num_rows
        answers = [None] * n if error else rows
        return pa.table({"request": group.column("request"), "__place": group.column("__place"), "spans": pa.array(answers, SPAN_ARROW), "error": pa.array([error] * n, pa.string())})

    schema = T.StructType([T.StructField("request", windows.schema[request].dataType), T.StructField("__place", T.IntegerType()), T.StructField("spans", T._parse_datatype_string(f"array<{SPAN}>")), T.StructField("error", T.StringType())])
    told = asked.groupBy("request").applyInArrow(run, schema).alias("a")
    same = F.col(f"w.{request}").eqNullSafe(F.col("a.request")) & (F.col("w.__place") == F.col("a.__place"))
    error = F.when(F.col("w.__place") > max_calls, F.lit("model_call_budget")).otherwise(F.col("a.error"))
    return ranked.alias("w").join(told, same, "left").select(*[F.col(f"w.`{c}`") for c in windows.columns], F.col("a.spans").alias("spans"), error.alias("error"))


def rechecked(text: str, tokenize: Callable[[str, bool], list[tuple[int, int]]], window: int = 448, overlap: int = 64, limit: int = 512) -> list[tuple[int, str]]:
    """(start, text) of windows that cover all characters, each of at most ``limit`` tokens when tokenised again by itself.

    ``tokenize(text, special)`` gives the character spans of the tokens, empty ones for special tokens. Windows are cut from left to right: each takes up to
    ``window`` of the text's tokens, as many as fit when it is read by itself, and the next begins ``overlap`` tokens before its end (at most half of
    it). A single token that does not fit is an error.
    """
    tokens = [a for a, b in tokenize(text, False) if a < b]
    # the first window begins with the text, the last one ends with it
    edges = [0, *tokens[1:], len(text)]
    out, first = [], 0
    while True:
        last = min(first + window, len(edges) - 1)
        while (size := len(tokenize(text[edges[first] : edges[last]], True))) > limit:
            if last == first + 1:
                raise RuntimeError("no window of this text is within the bound")
            # as much less as it was too long
            last = first + max(1, min(last - first - 1, (last - first) * limit // size))
        out.append((edges[first], text[edges[first] : edges[last]]))
        if last == len(edges) - 1:
            return out
        first = last - min(overlap, (last - first) // 2)


def model_windows(segments: DataFrame, tokenize: Callable[[str, bool], list[tuple[int, int]]], window: int = 448, overlap: int = 64, limit: int = 512, text: str = "text") -> DataFrame:
    """``segments`` exploded to windows of ``rechecked``: ``window_start`` and ``window_text`` in place of the text; a null text is empty."""
    names = [c for c in segments.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = [rechecked(t or "", tokenize, window, overlap, limit) for t in b.column(len(names)).to_pylist()]
            rows = pa.array([i for i, c in enumerate(cuts) for _ in c], pa.int32())
            own = [b.column(i).take(rows) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([s for c in cuts for s, _ in c], pa.int32()), pa.array([x for c in cuts for _, x in c], pa.string())], names=[*names, "window_start", "window_text"])

    schema = T.StructType([*[f for f in segments.schema.fields if f.name != text], T.StructField("window_start", T.IntegerType()), T.StructField("window_text", T.StringType())])
    return segments.select(*names, text).mapInArrow(run, schema)
