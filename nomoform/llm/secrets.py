"""Secret scan with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
ASSIGN = f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs of one class are maximal, so a least length may stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LOGIN = "(" + "|".join(map(_any_case, ("username", "user", "login", "account"))) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9._@-]+)"
ENDPOINT = "[a-z]+://[A-Za-z0-9./:@_-]+"
WEAK = "[A-Za-z0-9+/_=-]{20,}"
#: Code points between a weak candidate and the parts that complete it.
SCOPE = 200
KINDS = ("assign", "access", "hex", "linked")


def spans(text: Column, pattern: str, least_group: int = 0) -> Column:
    """Start and end, in code points, of the matches of a pattern with no empty match.

    The pieces between matches and the matches themselves give the offsets. With
    ``least_group`` a match stays only if its second group is that long.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least_group else found

    def build(gaps: Column) -> Column:
        return let(
            found,
            lambda m: F.aggregate(
                F.sequence(F.lit(0), F.size(m) - 1),
                F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
                lambda acc, i: F.struct(
                    (acc["at"] + F.length(F.get(gaps, i)) + F.length(F.get(m, i))).alias("at"),
                    F.array_append(
                        acc["out"],
                        F.struct(
                            (acc["at"] + F.length(F.get(gaps, i))).alias("s"),
                            (acc["at"] + F.length(F.get(gaps, i)) + F.length(F.get(m, i))).alias("e"),
                        ),
                    ).alias("out"),
                ),
            )["out"],
        )

    whole = let(F.split(text, pattern, -1), build)
    if least_group:
        whole = let(second, lambda g: F.filter(whole, lambda x, i: F.length(F.get(g, i)) >= least_group))
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def find_parts(docs: DataFrame) -> DataFrame:
    """doc_id, _key and the spans of each kind of part in every whole text."""
    text = F.coalesce("text", F.lit(""))
    named = docs.select(
        "doc_id",
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)).alias("_key"),
        spans(text, ASSIGN, 6).alias("assign"),
        spans(text, ACCESS).alias("access"),
        spans(text, HEX).alias("hex"),
        spans(text, LOGIN, 1).alias("login"),
        spans(text, ENDPOINT).alias("endpoint"),
        F.filter(
            spans(text, WEAK),
            lambda x: let(
                F.substr(text, x["s"] + 1, x["e"] - x["s"]),
                lambda t: t.rlike("[0-9]") & t.rlike("[a-z]") & t.rlike("[A-Z]"),
            ),
        ).alias("weak"),
    )
    clear = F.filter(
        "weak",
        lambda x: ~F.exists(F.flatten(F.array("assign", "access", "hex", "endpoint")), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])),
    )
    return named.withColumn("weak", clear)


def link_weak(parts: DataFrame) -> DataFrame:
    """_key and the weak spans that an identifier or an endpoint beside them completes within SCOPE.

    An interval join on cells of SCOPE code points: a part lies in the cell of
    its start, a weak span in all cells that its reach touches.
    """
    weak = parts.select("_key", F.explode("weak").alias("w")).select(
        "_key", "w", F.explode(F.sequence(F.expr("(w.s - %d) div %d" % (SCOPE, SCOPE)), F.expr("(w.e + %d) div %d" % (SCOPE, SCOPE)))).alias("cell")
    )
    other = parts.where(F.size("weak") > 0).select("_key", F.explode(F.concat("access", "login", "endpoint")).alias("o")).select(
        "_key", F.expr("o.s div %d" % SCOPE).alias("cell"), "o"
    )
    near = (F.col("o.s") >= F.col("w.s") - SCOPE) & (F.col("o.s") <= F.col("w.e") + SCOPE)
    near = near & ((F.col("o.e") <= F.col("w.s")) | (F.col("o.s") >= F.col("w.e")))  # a part that holds the candidate is no other part
    hits = weak.alias("x").join(other.alias("y"), (F.col("x._key") == F.col("y._key")) & (F.col("x.cell") == F.col("y.cell")) & near, "left_semi")
    return hits.groupBy("_key").agg(F.array_sort(F.collect_set("w")).alias("linked"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets per document: assign, access, hex, and linked weak candidates.

    ``docs``: doc_id, text; other columns are ignored. Returns doc_id, _key,
    and spans, an array of (s, kind_no, e) by start and kind, code points with
    the end exclusive. A long mixed token is only a candidate; it is reported
    as ``linked`` if an access identifier, a login or an endpoint starts within
    SCOPE code points of it. A null text is empty; repeated rows each get their
    row; an empty table gives none.
    """
    parts = cut(find_parts(docs), "secret-parts")
    linked = link_weak(parts.select("_key", "access", "login", "endpoint", "weak").where(F.size("weak") > 0))
    joined = parts.join(linked, "_key", "left")
    tag = lambda c, k: F.transform(F.coalesce(c, F.array().cast("array<struct<s:int,e:int>>")), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    return joined.select(
        "doc_id",
        "_key",
        F.array_sort(F.concat(*[tag(F.col(k), i) for i, k in enumerate(KINDS)])).alias("spans"),
    )


def as_text(spans_col: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_col, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(as_text(F.filter("spans", lambda x: x["k"] < 3)), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of text replaced by ``mark``; overlapping spans as one.

    Columns, whatever their names, and rows stay as they are but for text; a
    null text stays null, repeated rows are treated alike, and an empty table
    gives no rows.
    """
    found = secret_scan(docs.select("doc_id", "text")).where(F.size("spans") > 0).select("_key", "spans").dropDuplicates(["_key"])
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col("row.text")
    keyed = rows.withColumn("_key", F.md5(F.concat_ws(":", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))))
    walked = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)))
            .alias("out"),
        ),
    )
    rest = let(walked, lambda w: F.concat(w["out"], F.substr(text, w["at"] + 1, F.length(text))))
    joined = keyed.join(found, "_key", "left")
    clean = F.when(F.col("spans").isNotNull(), rest).otherwise(text)
    return joined.select(*[clean.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
