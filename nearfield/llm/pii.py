"""Personal data: base patterns, and more by bootstrapped contextual extraction. DataFrame functions only.

Every text is matched once for each base kind and once for identifier-like words; a match's place follows from the
lengths of what stands between matches. Base matches that pass their check (parts of an address, number of digits, Luhn)
are seeds. The words to the left of seeds are patterns. Patterns and the instances (seeds and identifier-like words) they
stand before form a graph: a pattern's score for a kind is the mean score of its instances, smoothed; an instance's score
is the chance that any of its patterns is right. In each turn the instances that score high become seeds, so patterns that
stand before enough different seeds, old and new, join the graph. After a few turns, such patterns that score high mark the
unseen identifiers behind them; those are spans of kind ``like_<kind>``. Base spans always stay.

An identifier-like word is a token without white space, of any length, that has a digit, without the marks around it.

Nulls: a null text is empty and has no spans. A null doc_id is kept. Repeated rows have their own, equal results. An empty
table gives no rows. Extra columns are not looked at.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that a failing match costs time in proportion to its length: runs are possessive, and
#: no match starts inside a run that has failed.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier that no base pattern finds: a whole token with a digit, of any length. A match has the marks
#: before the token's first letter or digit, which are taken off, and ends with its last one; it is tried once a token.
_SIGN, _MARK = r"[A-Za-z0-9\x80-\x{10FFFF}]", r"[^\sA-Za-z0-9\x80-\x{10FFFF}]"
CANDIDATE = rf"(?<!\S)(?=[^\s0-9]*+[0-9]){_MARK}*+{_SIGN}++(?:{_MARK}++{_SIGN}++)*+"
#: Characters of context kept on the left, different seeds a pattern needs, turns, smoothing, and the least score.
CONTEXT, MIN_SEEDS, TURNS, SMOOTHING, MIN_SCORE = 48, 5, 3, 1.0, 0.8


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total, i):
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: Column, value: Column) -> Column:
    """Does a match of a base kind hold?"""
    n = F.length(_digits(value))
    parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when((n >= 12) & (n <= 19), _luhn(_digits(value))).otherwise(False))
        .when(kind == "phone", (n >= 9) & (n <= 15))
        .otherwise(kind == "email")
    )


def _matches(text: Column, kind: str, pattern: str, when: Column | None = None) -> Column:
    """Structs (kind, place, value, gap, left) of the matches: the length of the text since the match before, and what
    stands directly before it."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<kind:string,place:int,value:string,gap:int,left:string>>")
    found = F.when(F.regexp_like(text, F.lit(pattern)), _once(hits, F.split(text, pattern, -1), kind))
    return F.coalesce(found if when is None else F.when(when, found), none)


def _once(hits: Column, gaps: Column, kind: str) -> Column:
    """Each array is computed once for a text: they are zipped, not looked up."""
    zipped = F.zip_with(hits, gaps, lambda v, g: F.struct(v.alias("v"), g.alias("g")))  # the last gap has no match
    return F.transform(F.filter(zipped, lambda z: z["v"].isNotNull()), lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("place"), z["v"].alias("value"), F.length(z["g"]).alias("gap"), F.right(z["g"], F.lit(CONTEXT)).alias("left")))


def _trimmed(m: Column) -> Column:
    """A candidate without the marks before it, which go to the text on its left."""
    value = F.regexp_replace(m["value"], f"^{_MARK}+", "")
    marks = F.length(m["value"]) - F.length(value)
    left = F.right(F.concat(m["left"], F.substring(m["value"], F.lit(1), marks)), F.lit(CONTEXT))
    return F.struct(m["kind"].alias("kind"), m["place"].alias("place"), value.alias("value"), (m["gap"] + marks).alias("gap"), left.alias("left"))


def found_matches(docs: DataFrame) -> DataFrame:
    """rid (a number of the row), doc_id, found: all matches of every row of ``docs``; written down, texts left behind."""
    text = F.coalesce("text", F.lit(""))
    kinds = [
        _matches(text, "email", PATTERNS["email"], F.instr(text, "@") > 0),
        _matches(text, "ip", PATTERNS["ip"]),
        _matches(text, "card", PATTERNS["card"]),
        _matches(text, "phone", PATTERNS["phone"], F.instr(text, "+") > 0),
        F.transform(_matches(text, "", CANDIDATE), _trimmed),
    ]
    return stored(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.concat(*kinds).alias("found")), "matches")


def _placed(found: DataFrame) -> DataFrame:
    """rid, kind, value, left, start, end (code points, end exclusive), of base matches that hold and of candidates."""
    rows = found.select("rid", F.inline("found"))
    before = Window.partitionBy("rid", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    rows = rows.select("rid", "kind", "value", "left", end.cast("long").alias("end"))
    rows = rows.withColumn("start", F.col("end") - F.length("value"))
    return rows.where((F.col("kind") == "") | _passes(F.col("kind"), F.col("value")))


def _patterns(left: Column) -> Column:
    """The last word, and the last two, before a match, as parts of patterns; digits count alike."""
    words = F.filter(F.split(F.lower(F.regexp_replace(left, "[0-9]", "#")), r"[\x09-\x0D\x20]+", -1), lambda w: w != "")
    n = F.size(words)
    return F.when(n >= 2, F.array(F.array_join(F.slice(words, -1, 1), " "), F.array_join(F.slice(words, -2, 2), " "))).when(
        n == 1, words).otherwise(F.array().cast("array<string>"))


def contextual(placed: DataFrame, min_seeds: int = MIN_SEEDS, turns: int = TURNS, min_score: float = MIN_SCORE) -> DataFrame:
    """rid, kind (like_<kind>), start, end: identifiers that no base pattern finds, by what stands before them."""
    base = placed.where("kind != ''")
    shadow = base.select("rid", F.col("start").alias("s"), F.col("end").alias("e"))
    # A candidate that overlaps a base span is that span.
    candidates = placed.where("kind = ''")
    seen = candidates.join(shadow, "rid").where("start < e AND s < end").select("rid", "start").distinct()
    fresh = candidates.join(seen, ["rid", "start"], "left_anti")
    linked = lambda df: df.select("rid", "start", "end", "kind", F.xxhash64("value").alias("instance"), F.explode(_patterns(F.col("left"))).alias("pattern"))
    seeds, others = linked(base), stored(linked(fresh).drop("kind"), "unseen")
    edges = stored(seeds.select("pattern", "instance", "kind").distinct(), "seed-edges")
    places = stored(others.select("pattern", "instance").distinct(), "unseen-edges")

    scores = edges.select("instance", "kind", F.lit(0.0).alias("score")).limit(0)

    def graph(scores):
        """Edges (pattern, instance, kind, score) of base matches and of unseen identifiers, behind patterns that stand
        before enough different seeds. Seeds are base matches and the instances that score enough by now."""
        found = scores.where(F.col("score") >= min_score).select("instance", "kind")
        support = edges.unionByName(places.join(found, "instance")).distinct()
        strong = stored(support.groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_seeds).select("pattern", "kind"), "strong")
        known = edges.join(strong, ["pattern", "kind"]).withColumn("score", F.lit(1.0))
        unseen = places.join(strong, "pattern").join(scores, ["instance", "kind"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        unseen = stored(unseen.select("pattern", "instance", "kind", "score"), "edges")
        scored = known.unionByName(unseen).groupBy("pattern", "kind").agg((F.sum("score") / (F.count("*") + SMOOTHING)).alias("of_pattern"))
        return unseen, scored

    for _ in range(turns):
        unseen, scored = graph(scores)
        scores = stored(unseen.join(scored, ["pattern", "kind"]).groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("of_pattern")))))).alias("score")), "scores")
    sure = graph(scores)[1].where(F.col("of_pattern") >= min_score)
    hits = others.join(sure, "pattern").groupBy("rid", "start", "end").agg(F.max_by("kind", F.struct("of_pattern", "kind")).alias("kind"))
    return hits.select("rid", F.concat(F.lit("like_"), "kind").alias("kind"), "start", "end")


def personal_spans(docs: DataFrame, **options) -> DataFrame:
    """rid, doc_id, spans (structs of start, order, kind, end; sorted): one row for each row of ``docs``."""
    found = found_matches(docs)
    placed = stored(_placed(found), "placed")
    base = placed.where("kind != ''").select("rid", "kind", "start", "end")
    every = base.unionByName(contextual(placed, **options))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", F.when(order > 0, order).otherwise(len(KINDS) + 1).alias("order"), "kind", "end")
    per_row = every.groupBy(F.col("rid").alias("r")).agg(F.sort_array(F.collect_list(span)).alias("spans"))  # of one text
    none = F.array().cast(dict(per_row.dtypes)["spans"])
    return found.select("rid", "doc_id").join(per_row, F.col("rid") == F.col("r"), "left").select("rid", "doc_id", F.coalesce("spans", none).alias("spans"))


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of ``docs``."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["order"] <= len(KINDS))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return personal_spans(docs, **options).select(
        "doc_id", *[of(k) for k in KINDS],
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"))
