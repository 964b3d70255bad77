"""Secret scans: multipart credential linking.

Strong spans (assignments, access identifiers, long hex runs) stand by themselves. Weak candidates - plain user or key
identifiers, opaque tokens, endpoints - say little alone; an interval join finds those with a gap of at most `reach` code
points to a complementary part in the same document, and only these are reported.

Defined results: null or empty text has no spans. Repeated rows are scanned one by one (a row number, not doc_id, ties
the parts of a row together), null ids too. Overlapping spans are all reported, in order of their start and then of
their kind. Texts of any length are scanned whole, an empty table gives an empty one. Extra columns are carried through;
this module's own column names start with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import Workspace

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
BASE_KINDS = KINDS[:3]
#: What part of a credential a kind can be.
PART = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "id", "ident": "id", "endpoint": "place"}
#: A weak candidate is reported if one of these parts lies within reach.
COMPLEMENTS = {"ident": ("secret",), "opaque": ("id", "place"), "endpoint": ("secret",)}
REACH = 160

_GAP = r"""["']?\x20*[:=]\x20*["']?"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
_IDENT_KEYS = "|".join(_either_case(w) for w in ("username", "user", "login", "account", "client_id", "access_key_id", "access_key"))
#: kind: (pattern, group whose length counts, least length). No pattern can match a line feed.
PATTERNS = {
    "assign": (rf"({_ASSIGN_KEYS}){_GAP}([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "ident": (rf"({_IDENT_KEYS}){_GAP}([A-Za-z0-9_.@-]+)", 2, 3),
    "opaque": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    "endpoint": (r"""(?:[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}(?![0-9.]))""", 0, 8),
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once; a plain reference inside a lambda would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column) -> Column:
    """[0, a, a+b, ...] for [a, b, ...], one element longer. Every step copies what it has."""
    return F.aggregate(
        lengths,
        F.struct(F.array(F.lit(0).cast("long")).alias("at"), F.lit(0).cast("long").alias("sum")),
        lambda acc, n: F.struct(F.concat(acc["at"], F.array(acc["sum"] + n)).alias("at"), (acc["sum"] + n).alias("sum")),
        lambda acc: acc["at"],
    )


def _starts(lengths: Column, part: int = 256) -> Column:
    """[0, a, a+b, ...] for [a, b, ...], equally long: by parts, so that the copies stay short for many lengths."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / part).cast("int")), lambda i: F.slice(lengths, i * part + 1, F.lit(part)))
    totals = lambda ps: F.transform(ps, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, n: a + n))
    moved = lambda x: F.flatten(F.transform(x["parts"], lambda p, i: F.transform(F.slice(_running(p), F.lit(1), F.size(p)), lambda v: v + x["base"][i])))
    return _let(parts, lambda ps: _let(F.struct(ps.alias("parts"), _running(totals(ps)).alias("base")), moved))


def spans_of(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind as array<struct<start, kind, end>>, in code points, end exclusive.

    The gaps between matches (split) and the matches themselves give the places without a search per match.
    """
    pattern, group, least = PATTERNS[kind]
    number = KINDS.index(kind)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    sizes = F.transform(F.arrays_zip(whole.alias("m"), counted.alias("c")), lambda x: F.struct(F.length(x["m"]).cast("long").alias("m"), F.length(x["c"]).alias("c")))

    def place(x):
        # step i covers gap i and match i, so the match starts at the running sum of steps before it plus its gap
        steps = F.zip_with(x["gaps"], x["sizes"], lambda g, s: g + F.coalesce(s["m"], F.lit(0).cast("long")))
        return _let(
            F.struct(x["gaps"].alias("gaps"), x["sizes"].alias("sizes"), _let(steps, lambda z: _starts(z)).alias("at")),
            lambda y: F.filter(
                F.transform(
                    y["sizes"],
                    lambda s, i: F.when(s["c"] >= least, F.struct((y["at"][i] + y["gaps"][i]).alias("start"), F.lit(number).alias("kind"), (y["at"][i] + y["gaps"][i] + s["m"]).alias("end"))),
                ),
                lambda s: s.isNotNull(),
            ),
        )

    found = _let(F.struct(gaps.alias("gaps"), sizes.alias("sizes")), place)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def link_parts(parts: DataFrame, scope: list[str], reach: int = REACH) -> DataFrame:
    """Interval join of credential parts within scopes.

    parts: the scope's columns, start, kind, end. Returns the weak candidates with a complementary part in their scope
    at a gap of at most reach: the later one's start less the earlier one's end, 0 if they overlap. One sweep over each
    scope and part: parts stand at their starts, and a candidate asks at its end plus reach, where the greatest end of
    the parts met so far must not be more than reach before its start. However long a part is, it counts to its end,
    and however many parts a scope holds, no pairs are formed.
    """
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    part = F.element_at(F.create_map(*[F.lit(x) for kv in PART.items() for x in kv]), name)
    wanted = F.array(*[F.struct(F.lit(KINDS.index(k)).alias("k"), F.lit(p).alias("p")) for k, ps in COMPLEMENTS.items() for p in ps])
    stands = F.struct(part.alias("part"), F.lit(0).alias("asks"), F.col("start").alias("at"), F.col("end").alias("stands_to"))
    asks = F.transform(
        F.filter(wanted, lambda w: w["k"] == F.col("kind")),
        lambda w: F.struct(w["p"].alias("part"), F.lit(1).alias("asks"), (F.col("end") + reach).alias("at"), F.lit(None).cast("long").alias("stands_to")),
    )
    events = parts.select(*scope, "start", "kind", "end", F.explode(F.concat(F.array(stands), asks)).alias("_e")).select(*scope, "start", "kind", "end", "_e.*")
    sweep = Window.partitionBy(*scope, "part").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = events.withColumn("_end", F.max("stands_to").over(sweep))
    return met.filter((F.col("asks") == 1) & (F.col("start") - F.col("_end") <= reach)).select(*scope, "start", "kind", "end").distinct()


def overlaps(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < a["end"]) & (a["start"] < s["end"]))


def _scan(docs: DataFrame, text: str, reach: int, cols: list[str]) -> DataFrame:
    """The named columns of docs with _base and _spans; cols must not start with an underscore followed by a letter."""
    work = Workspace(docs.sparkSession, "secrets")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.sort_array(F.concat(*[spans_of(body, k) for k in BASE_KINDS]))
    weak = F.concat(*[spans_of(body, k) for k in KINDS[len(BASE_KINDS) :]])
    found = docs.select(*cols, F.monotonically_increasing_id().alias("_row"), base.alias("_base"), weak.alias("_weak"))
    found = work.keep(found, "found")
    # a weak span that lies over a strong one adds nothing
    weak = F.filter(F.col("_weak"), lambda w: ~overlaps(w, F.col("_base")))
    parts = found.filter(F.size("_weak") > 0).select("_row", F.explode(F.concat(F.col("_base"), weak)).alias("s")).select("_row", "s.*")
    linked = link_parts(parts, ["_row"], reach).groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("_linked"))
    spans = F.sort_array(F.concat(F.col("_base"), F.coalesce(F.col("_linked"), F.array().cast(found.schema["_base"].dataType))))
    return found.join(linked, "_row", "left").select(*cols, "_base", spans.alias("_spans"))


def _positional(docs: DataFrame) -> DataFrame:
    """docs with its columns named by place, so that none clashes with a name used here."""
    return docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])


def scan(docs: DataFrame, text: str = "text", reach: int = REACH, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those in keep) with _base and _spans: array<struct<start, kind, end>> by start, kind.

    The text is scanned once; the parts found are written to the shared folder, linked there, and come back per row.
    Input columns named _base or _spans are replaced.
    """
    place = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("_base", "_spans")]
    found = _scan(_positional(docs), place[text], reach, [place[c] for c in names])
    return found.toDF(*names, "_base", "_spans")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones united, as array<struct<start, end>>."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(
        spans,
        F.array().cast(kind),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        )
        .otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
        .cast(kind),
    )


def mask(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """docs with every reported span of text replaced by mark; rows, columns and their order stay. Null text stays null."""

    place = f"_{docs.columns.index(text)}"
    found = _scan(_positional(docs), place, reach, [f"_{i}" for i in range(len(docs.columns))])
    body = F.col(place)
    pieces = lambda m: F.concat(
        F.transform(m, lambda s, i: F.concat(F.substring(body, F.when(i == 0, F.lit(1).cast("long")).otherwise(F.try_element_at(m, i)["end"] + 1).cast("int"), (s["start"] - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.try_element_at(m, i)["end"])).cast("int")), F.lit(mark))),
        F.array(F.substring(body, (F.element_at(m, F.lit(-1))["end"] + 1).cast("int"), F.length(body))),
    )
    masked = F.when(F.size("_spans") > 0, _let(merged(F.col("_spans")), lambda m: F.array_join(pieces(m), ""))).otherwise(body)
    return found.select(*[(masked if c == text else F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns)])
