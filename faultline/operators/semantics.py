"""What function names and payloads say about a record: textual features, their unit vector, and two signatures.

Everything is a column expression over the function name, the JSON text of the event and an error message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: the features in the order of the vector
FEATURES = ("func_complexity", "has_handler", "has_api", "payload_depth", "payload_keys", "has_nested_objects", "has_error", "error_type")
DIMENSION = 32

# --- fixed values: error classes by the first word that a message holds ---
ERRORS = ((("timeout",), 1.0), (("memory",), 2.0), (("permission", "auth"), 3.0), (("network", "connection"), 4.0))
OTHER_ERROR = 0.5


def _bare(json: Column) -> Column:
    """JSON with each string cut to one letter. Escapes go first, so that the pattern has no branches and long strings need no stack."""
    return F.regexp_replace(F.regexp_replace(json, r"\\.", ""), '"[^"]*"', "s")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _nesting(json: Column) -> Column:
    """Fold over the brackets of a JSON object: depth of nested objects that are not empty, and whether a value of the outer one is an object.

    Objects inside lists do not count, as lists are not entered.
    """
    brackets = F.regexp_replace(_bare(json), r"[^\[\]{}:]", "")  # a value keeps its colon, so only {} is empty
    marks = F.split(F.regexp_replace(F.regexp_replace(brackets, r"\{\}", "e"), ":", ""), "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("lists"), F.lit(0).alias("deepest"), F.lit(False).alias("inner"))

    def step(s: Column, c: Column) -> Column:
        out = s["lists"] == 0
        at = s["at"] + F.when(out & (c == "{"), 1).when(out & (c == "}"), -1).otherwise(0)
        return F.struct(at.alias("at"), (s["lists"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)).alias("lists"),
                        F.greatest(s["deepest"], at).alias("deepest"), (s["inner"] | (out & (s["at"] == 1) & c.isin("{", "e"))).alias("inner"))

    return F.aggregate(marks, start, step)


def error_type(message: Column) -> Column:
    """Class of an error message; 0 without one."""
    low, out = F.lower(message), F.when(F.coalesce(message, F.lit("")) == "", 0.0)
    for words, value in ERRORS:
        out = out.when(reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in words]), value)
    return out.otherwise(OTHER_ERROR)


def describe(df: DataFrame, function: str = "function_id", event: str = "event", error: str = "error_message") -> DataFrame:
    """Adds ``textual`` (a struct of ``FEATURES``), ``call_pattern`` and ``payload_signature``.

    ``event`` is JSON text. Where it is null, no JSON or no object, the three payload features are null and both signatures
    are those of an empty event. A body may be an object or text that holds JSON; text that does not is ``invalid_json``, a
    missing, empty, zero or false one ``no_payload``. Characters beyond ASCII enter the hashes as they are.
    """
    rows = df.withColumn("_v", F.try_parse_json(F.col(event)))
    rows = rows.withColumns({"_json": F.to_json("_v"), "_raw": F.expr("to_json(try_variant_get(_v, '$.body', 'variant'))")})
    rows = rows.withColumn("_dict", F.coalesce(F.startswith("_json", F.lit("{")), F.lit(False)))
    rows = rows.withColumns({
        "_raw": F.when(F.col("_dict") & ~F.col("_raw").isin('""', "{}", "[]", "0", "0.0", "false", "null"), F.col("_raw")),
        "_nest": F.when(F.col("_dict"), _nesting(F.col("_json"))),
    })
    text = F.when(F.startswith("_raw", F.lit('"')), F.expr("try_variant_get(_v, '$.body', 'string')")).otherwise(F.col("_raw"))
    rows = rows.withColumn("_body", F.to_json(F.try_parse_json(text)))
    name = F.lower(F.col(function))
    features = (
        F.size(F.split(name, "-")).cast("double"), _flag(F.contains(name, F.lit("handler"))), _flag(F.contains(name, F.lit("api"))),
        F.col("_nest.deepest").cast("double"), F.when(F.col("_dict"), F.size(F.json_object_keys("_json")).cast("double")), F.when(F.col("_dict"), _flag(F.col("_nest.inner"))),
        _flag(F.coalesce(F.col(error), F.lit("")) != ""), error_type(F.col(error)))
    out = rows.withColumns({
        "textual": F.struct(*[c.alias(n) for n, c in zip(FEATURES, features)]),
        "call_pattern": _call_pattern(), "payload_signature": F.when(F.col("_raw").isNull(), "no_payload").when(F.col("_body").isNull(), "invalid_json").otherwise(_shape())})
    return out.drop("_v", "_json", "_raw", "_dict", "_nest", "_body")


def _quoted(c: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _call_pattern() -> Column:
    """First 8 hex digits over the JSON of method, path, number of headers and presence of a body."""
    held = lambda p: F.coalesce(F.when(F.col("_dict"), F.expr(f"try_variant_get(_v, '$.{p}', 'string')")), F.lit(""))
    headers = F.coalesce(F.when(F.col("_dict"), F.size(F.json_object_keys(F.expr("to_json(try_variant_get(_v, '$.headers', 'variant'))")))), F.lit(0))
    return F.substring(F.md5(F.concat(
        F.lit('{"body_present": '), F.when(F.col("_raw").isNotNull(), "true").otherwise("false"), F.lit(', "headers_count": '), F.greatest(headers, F.lit(0)).cast("string"),
        F.lit(', "method": '), _quoted(held("httpMethod")), F.lit(', "path": '), _quoted(held("path")), F.lit("}")).cast("binary")), 1, 8)


def _shape() -> Column:
    """First 8 hex digits over the JSON of the sorted keys, the size with spaces after separators, and the type of a body."""
    first, body = F.substring("_body", 1, 1), F.col("_body")
    kind = F.when(first == "{", "dict").when(first == "[", "list").when(first == '"', "str").when(first.isin("t", "f"), "bool").when(first == "n", "NoneType").when(
        F.rlike(body, F.lit("[.eE]")), "float").otherwise("int")
    keys = F.when(first == "{", F.sort_array(F.json_object_keys(body)))
    listed = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(keys, _quoted), ", "), F.lit("")), F.lit("]"))
    gaps = F.length(F.regexp_replace(_bare(body), "[^,:]", ""))
    size = F.when(first == '"', F.length(F.expr("try_variant_get(try_parse_json(_body), '$', 'string')"))).otherwise(F.length(body) + gaps)
    return F.substring(F.md5(F.concat(F.lit('{"keys": '), listed, F.lit(', "size": '), size.cast("string"), F.lit(', "type": "'), kind, F.lit('"}')).cast("binary")), 1, 8)


def embedding(textual: str = "textual", dimension: int = DIMENSION) -> Column:
    """The features that are there, in order, padded to ``dimension`` and brought to unit length; zeros stay zeros."""
    there = F.array_compact(F.array(*[F.col(f"{textual}.{f}") for f in FEATURES]))
    whole = F.slice(F.concat(there, F.array_repeat(F.lit(0.0), dimension)), 1, dimension)
    norm = F.sqrt(F.aggregate(there, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(whole, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def _packed(side: str, k: int) -> Column:
    """The k-th feature that is there: without a payload the later ones move up."""
    t = [F.col(f"{side}.{f}") for f in FEATURES]
    return t[k] if k < 3 else F.when(t[3].isNotNull(), t[k]).otherwise(t[k + 3] if k + 3 < len(t) else F.lit(0.0))


def cosine(a: str, b: str) -> Column:
    """Cosine of two feature structs as vectors, not below 0, written out so that it compiles into the join's projection."""
    dot = lambda x, y: reduce(lambda p, q: p + q, [_packed(x, k) * _packed(y, k) for k in range(len(FEATURES))])
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))), F.lit(0.0))


def textual_similarity(a: str, b: str) -> Column:
    """Mean likeness of the features that both records have: 1 - |x - y| / max(1, |x|, |y|)."""
    pairs = [(F.col(f"{a}.{f}"), F.col(f"{b}.{f}")) for f in FEATURES]
    like = [1 - F.abs(x - y) / F.greatest(F.lit(1.0), F.abs(x), F.abs(y)) for x, y in pairs]
    both = reduce(lambda p, q: p + q, [F.when(c.isNull(), 0.0).otherwise(1.0) for c in like])
    return reduce(lambda p, q: p + q, [F.coalesce(c, F.lit(0.0)) for c in like]) / both


def similarity(a: str = "a_", b: str = "b_") -> Column:
    """Semantic likeness of two described records: function .25, vectors .35, features .2, payload .1, error message .1."""
    same = lambda c: F.when(F.col(f"{a}{c}") == F.col(f"{b}{c}"), 1.0).otherwise(0.0)
    error = F.when(F.coalesce(F.col(f"{a}error_message"), F.lit("")) == F.coalesce(F.col(f"{b}error_message"), F.lit("")), 1.0).otherwise(0.0)
    return (0.25 * same("function_id") + 0.35 * cosine(f"{a}textual", f"{b}textual") + 0.2 * textual_similarity(f"{a}textual", f"{b}textual")
            + 0.1 * same("payload_signature") + 0.1 * error)
