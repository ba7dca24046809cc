"""Secrets in texts: certain patterns, and weak candidates that count only beside their other parts (DataFrame functions only).

Certain spans, leftmost and non-overlapping within a kind:
* assign: a keyword, a colon or equals sign, and a value of six characters or more,
* access: AKIA and capitals or digits, 20 characters or more,
* hex: 24 or more of 0-9a-f.

A credential has several parts: an identifier, a secret and an endpoint. Weak candidates are account names and ids
(`identifier`), long mixed tokens (`secret`) and addresses (`endpoint`). Alone they say little, so they are reported
only by an interval join: their complement must start within REACH characters in the same scope, a passage between
blank lines. An identifier needs a secret, a secret an identifier or an endpoint, an endpoint both others. Certain
spans are parts too: access is an identifier, assign and hex are secrets.

Each candidate meets, in its own and the two neighbouring intervals of REACH characters, one row per kind with the
first and last start there. That decides the join exactly without pairing candidates.

Positions are code points, ends exclusive. A null or empty text has no spans. Results depend on the text alone, so
copies and repeated rows get the same ones; doc_id may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, fresh, join_small, text_key

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
PATTERNS = {
    "assign": KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "identifier": r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client[_-]?id|access[_-]?(?:key[_-]?)?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}""",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}",
    "endpoint": r"""(?<![A-Za-z0-9])(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\x20\x09-\x0D"'<>]+""",
}
VALUE_LEAST = 6
REACH = 300
SCOPE = r"\n[\x20\x09]*\n"
SPAN = "array<struct<start:int,kind:int,end:int>>"
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
#: The part that each kind of span is.
PART = (SECRET, IDENTIFIER, SECRET, IDENTIFIER, SECRET, ENDPOINT)


def _spans(body: Column, name: str) -> Column:
    """All matches of a pattern with their places, from the lengths of matches and of what lies between them."""
    pattern = F.lit(PATTERNS[name])
    kind = KINDS.index(name)
    found = F.regexp_extract_all(body, pattern, F.lit(0))
    parts = F.arrays_zip(F.transform(F.split(body, pattern, -1), F.length).alias("gap"), found.alias("match"))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,match:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"))
        return F.struct((start + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"),
                        F.when(x["match"].isNull(), acc["all"]).otherwise(F.concat(acc["all"], F.array(span))).alias("all"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("all")), step, lambda acc: acc["all"])
    if name == "assign":
        spans = F.filter(spans, lambda x: F.length(F.regexp_extract(x["match"], PATTERNS[name], 2)) >= VALUE_LEAST)
    spans = F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return F.when(F.size(found) > 0, spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _certain(body: Column) -> Column:
    return F.array_sort(F.concat(*[_spans(body, k) for k in KINDS[:3]]))


def _weak(body: Column, certain: Column) -> Column:
    """Weak candidates that do not overlap a certain span."""
    both = F.concat(*[_spans(body, k) for k in KINDS[3:]])
    return F.filter(both, lambda w: ~F.exists(certain, lambda c: (c["start"] < w["end"]) & (w["start"] < c["end"])))


def _parts(docs: DataFrame) -> DataFrame:
    """doc_id, key, certain, weak, scopes (where each scope but the first begins): a row for each document."""
    body = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), body.alias("body"))
    d = d.withColumn("certain", _certain(F.col("body")))
    d = d.withColumn("weak", _weak(F.col("body"), F.col("certain")))
    # A separator is as long as it is: blank lines hold any number of blanks.
    lengths = F.zip_with(F.transform(F.split("body", SCOPE, -1), F.length), F.transform(F.regexp_extract_all("body", F.lit(SCOPE), F.lit(0)), F.length),
                         lambda passage, separator: passage + F.coalesce(separator, F.lit(0)))
    ends = F.aggregate(lengths, F.expr("cast(array(0) as array<int>)"), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return d.withColumn("scopes", F.when(F.size("weak") > 0, ends)).select("doc_id", "key", "certain", "weak", "scopes")


def _linked(parts: DataFrame) -> DataFrame:
    """key, linked (the weak candidates with their complement): texts that have any."""
    texts = parts.where("size(weak) > 0").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("certain", "weak", "scopes")])
    part_of = F.array(*[F.lit(p) for p in PART])
    each = texts.select("key", "scopes", F.inline(F.concat("certain", "weak")))
    each = each.select(
        "key", "start", "kind", "end", F.get(part_of, F.col("kind")).alias("part"),
        F.size(F.filter("scopes", lambda s: s <= F.col("start"))).alias("scope"), F.floor(F.col("start") / REACH).alias("slot"))
    met = each.groupBy("key", "scope", "slot", "part").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    near = met.select("key", "scope", F.explode(F.array(F.col("slot") - 1, "slot", F.col("slot") + 1)).alias("slot"),
                      F.col("part").alias("other"), "first", "last")
    close = (F.col("last") >= F.col("start") - REACH) & (F.col("first") <= F.col("start") + REACH)
    seen = (each.where(F.col("kind") >= 3).join(near, ["key", "scope", "slot"]).where((F.col("other") != F.col("part")) & close)
            .groupBy("key", "start", "kind", "end", "part").agg(F.collect_set("other").alias("others")))
    has = [F.array_contains("others", p) for p in (IDENTIFIER, SECRET, ENDPOINT)]
    enough = (((F.col("part") == IDENTIFIER) & has[SECRET]) | ((F.col("part") == SECRET) & (has[IDENTIFIER] | has[ENDPOINT]))
              | ((F.col("part") == ENDPOINT) & has[IDENTIFIER] & has[SECRET]))
    return seen.where(enough).groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked: a row for each document."""
    store = store or Store(docs.sparkSession)
    parts = store.put(_parts(docs))
    linked = store.put(_linked(parts))
    d = join_small(parts.select("doc_id", "key", "certain"), linked, "key")
    none = F.expr(f"cast(array() as {SPAN})")
    counts = [F.size(F.array_remove(F.transform("certain", lambda x: x["kind"] == k), False)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return d.select(
        "doc_id", *counts, F.sha2(_written(F.col("certain")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("certain", F.coalesce("linked", none)))).alias("spans"),
        F.size(F.coalesce("linked", none)).cast("long").alias("n_linked"))


def redact(docs: DataFrame, store: Store | None = None, mask: str = "[removed]") -> DataFrame:
    """The rows and columns of `docs`, with every span of the text replaced by `mask`; n_chars follows the text."""
    store = store or Store(docs.sparkSession)
    linked = store.put(_linked(store.put(_parts(docs))))
    key, extra = fresh(docs, "text_key"), fresh(docs, "linked_spans")
    d = docs.withColumn(key, text_key(F.col("text")))
    d = join_small(d, linked.select(F.col("key").alias(key), F.col("linked").alias(extra)), key)
    none = F.expr(f"cast(array() as {SPAN})")
    spans = F.array_sort(F.concat(_certain(F.coalesce("text", F.lit(""))), F.coalesce(extra, none)))

    def step(acc: Column, x: Column) -> Column:
        new = F.when(x["start"] >= acc["at"], F.concat(acc["text"], F.substring("text", acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.coalesce(new, acc["text"]).alias("text"))

    spans_name = fresh(docs, "all_spans")
    d = d.withColumn(spans_name, spans)
    cut = F.aggregate(spans_name, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step,
                      lambda acc: F.concat(acc["text"], F.substring("text", acc["at"] + 1, F.length("text"))))
    # The new text is made before it takes the old one's name: a select would resolve names in it to its own aliases.
    new, found = fresh(docs, "new_text"), F.size(spans_name) > 0
    d = d.withColumn(new, F.when(found, cut).otherwise(F.col("text")))
    columns = {"text": F.col(new).alias("text")}
    if "n_chars" in docs.columns:
        size = F.length(new).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(found, size).otherwise(F.col("n_chars")).alias("n_chars")
    return d.select(*[columns.get(c, F.col(c)) for c in docs.columns])
