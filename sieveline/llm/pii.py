"""Personal data: base patterns, then bootstrapped contextual extraction.

Base spans are seeds. The word beside a seed is a lexical pattern, alone and with
the outline of the value. With an outline a pattern is trusted by the share of
seeds among the distinct values it meets; a word alone, which also names values
of a form that no seed has, by the share of its places in all texts at which a
seed stands. A value is trusted by the patterns it meets. Both sides of this
graph are scored in turn, and values found this way are seeds of the next round,
until none is found. Everything is DataFrame expressions, aggregates and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, fresh_names, materialize, row_key

#: The kinds in their order, with their patterns. Possessive
#: quantifiers and the look-behinds change no match: a run that fails at its
#: start fails at its later places too, and \G is where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: What might be an identifier: a run of address characters with a digit or an
#: @, and runs of digits behind it; and how long it is at least.
CANDIDATE = r"(?<![A-Za-z0-9@._%+()-])(?=[A-Za-z(+._%-]*+[0-9@])[A-Za-z0-9@._%+()-]*[A-Za-z0-9](?:\)?\x20\(?[0-9](?:[0-9().-]*[0-9])?)*+"
CANDIDATE_LENGTH = 6
#: Characters of context that are looked at first; longer words are sought whole.
NEAR = 60
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Sums are taken in blocks of this many, so that many matches stay cheap.
BLOCK = 256


@dataclass(frozen=True)
class Bootstrap:
    """least_values: distinct seed values that a pattern must meet;
    pattern_trust and value_trust: scores from which each is accepted. Rounds
    end with the first that accepts no value."""

    least_values: int = 3
    pattern_trust: float = 0.8
    value_trust: float = 0.9


def _running_sums(values: Column) -> Column:
    """Sums of all values up to each, itself included."""
    none = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), none.alias("a"))
    count = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), count),
        lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, BLOCK), zero, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a"))),
    )
    before = F.aggregate(blocks, zero, lambda acc, b: F.struct((acc["s"] + b["s"]).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))["a"]
    return F.flatten(F.zip_with(blocks, before, lambda b, o: F.transform(b["a"], lambda v: v + o)))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "email":
        return F.lit(True)
    return (F.length(value) >= CANDIDATE_LENGTH) & ((F.length(digits) >= 4) | F.contains(value, F.lit("@")))


def _outline(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Za-z]+", "a")


def scan(docs: DataFrame, keep: str = "") -> DataFrame:
    """doc_id, the row key, and found: all valid matches of the kinds and all
    candidates (kind empty) with place and context. With ``keep`` the columns of
    ``docs`` too, as a struct of that name."""
    rest = [F.struct(*[docs[c] for c in docs.columns]).alias(keep)] if keep else []
    rows = docs.select("doc_id", *row_key(docs), F.coalesce("text", F.lit("")).alias("text"), *rest)
    rows = rows.withColumn("digit", F.col("text").rlike("[0-9]")).withColumn("at", F.contains("text", F.lit("@")))
    needs = {"email": F.col("at"), "ip": F.col("digit") & F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("digit"), "phone": F.col("digit") & F.contains("text", F.lit("+")), "": F.col("digit") | F.col("at")}
    patterns = PATTERNS | {"": CANDIDATE}
    spans = []
    for kind, pattern in patterns.items():
        name = kind or "other"
        rows = rows.withColumn(f"m_{name}", F.when(needs[kind], F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
        some = F.size(f"m_{name}") > 0
        rows = rows.withColumn(f"p_{name}", F.when(some, F.split("text", pattern)))
        gaps = F.zip_with(F.slice(f"p_{name}", 1, F.size(f"m_{name}")), f"m_{name}", lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
        rows = rows.withColumn(f"e_{name}", F.when(some, _running_sums(gaps)))
        spans.append(_spans(kind, name, some))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,vh:bigint,outline:string,left:string,right:string,before:boolean,after:boolean>>")
    return rows.select("doc_id", *ROW_KEY, F.concat(*[F.coalesce(s, empty) for s in spans]).alias("found"), *([keep] if keep else []))


def _beside(piece: Column, last: bool) -> Column:
    """The last or first word of a piece of text, lower-cased."""
    near = F.right(piece, F.lit(NEAR)) if last else F.left(piece, F.lit(NEAR))
    word = F.regexp_extract(near, r"(\S+)\s*$" if last else r"^\s*(\S+)", 1)
    whole = F.length(F.trim(near)) > F.length(word)
    all_words = F.filter(F.split(piece, r"\s+"), lambda w: w != "")
    far = F.coalesce(F.get(all_words, F.size(all_words) - 1 if last else F.lit(0)), F.lit(""))
    return F.lower(F.when(whole | (F.length(piece) <= NEAR), word).otherwise(far))


def _spans(kind: str, name: str, some: Column) -> Column:
    def one(m: Column, i: Column) -> Column:
        end = F.element_at(f"e_{name}", i + 1)
        ahead, behind = F.element_at(f"p_{name}", i + 1), F.element_at(f"p_{name}", i + 2)
        return F.struct(
            F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), F.xxhash64(m).alias("vh"), _outline(m).alias("outline"),
            _beside(ahead, True).alias("left"), _beside(behind, False).alias("right"), F.right(ahead, F.lit(1)).rlike(r"\s").alias("before"), F.left(behind, F.lit(1)).rlike(r"\s").alias("after"), _valid(kind, m).alias("ok"),
        )

    valid = F.filter(F.transform(f"m_{name}", one), lambda s: s["ok"])
    return F.when(some, F.transform(valid, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "vh", "outline", "left", "right", "before", "after")])))


def discover(docs: DataFrame, found: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """Candidates that trusted patterns name: the row key, start, end, kind.

    ``found`` has one row per match in ``docs``: the row key and the fields of
    ``scan``; kind is empty for candidates.
    """
    cells = F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor((F.col("end") - 1) / 64))).alias("cell")
    named = found.where("kind <> ''").select(*ROW_KEY, F.col("start").alias("s"), F.col("end").alias("e"), cells)
    open_ = found.where("kind = ''")
    taken = open_.select(*ROW_KEY, "start", "end", cells).join(named, [*ROW_KEY, "cell"]).where("s < end and start < e").select(*ROW_KEY, "start", "end").distinct()
    open_ = open_.join(taken, [*ROW_KEY, "start", "end"], "left_anti")
    rows = materialize(found.where("kind <> ''").unionByName(open_), "instances")
    pattern = lambda mark, *of: F.concat_ws(" ", F.lit(mark), *of)
    patterns = F.array(
        pattern("L", "left", "outline"), pattern("R", "right", "outline"),
        F.when(F.col("before") & (F.col("left") != ""), pattern("l", "left")), F.when(F.col("after") & (F.col("right") != ""), pattern("r", "right")),
    )
    dealt = rows.select("vh", "kind", F.explode(patterns).alias("pattern")).where("pattern is not null")
    edges = materialize(dealt.groupBy("vh", "kind", "pattern").agg(F.count(F.lit(1)).alias("places")), "edges")
    # How often the words beside candidates stand anywhere.
    cues = edges.where("kind = ''").select("pattern").distinct().where(F.col("pattern").startswith("l ") | F.col("pattern").startswith("r "))
    cues = cues.withColumn("word", F.substring("pattern", 3, 1 << 30))
    words = docs.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("standing"))
    cues = materialize(cues.join(words, "word").select("pattern", "standing"), "cues")
    accepted = edges.sparkSession.createDataFrame([], "vh bigint, new string")
    while True:
        marked = edges.join(accepted, "vh", "left").withColumn("kind", F.when(F.col("kind") == "", F.coalesce("new", F.lit(""))).otherwise(F.col("kind"))).drop("new")
        counts = marked.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("places").alias("places"))
        best = counts.groupBy("pattern").agg(F.sum("n").alias("all"), F.max(F.when(F.col("kind") != "", F.struct("n", "places", "kind"))).alias("b")).where(F.col("b.n") >= settings.least_values)
        trust = F.least(F.coalesce(F.col("b.places") / F.col("standing"), F.col("b.n") / F.col("all")), F.lit(1.0))
        trusted = best.join(cues, "pattern", "left").where(trust >= settings.pattern_trust).select("pattern", F.col("b.kind").alias("new"), trust.alias("trust"))
        trusted = materialize(trusted, "patterns")
        scores = marked.where("kind = ''").join(trusted, "pattern").groupBy("vh", "new").agg(F.round(1 - F.exp(F.sum(F.log(1.001 - F.col("trust")))), 6).alias("score"))
        fresh = materialize(scores.where(F.col("score") >= settings.value_trust).groupBy("vh").agg(F.max(F.struct("score", "new")).alias("b")).select("vh", "b.new"), "values")
        if fresh.isEmpty():
            break
        accepted = materialize(accepted.unionByName(fresh), "accepted")
    return rows.where("kind = ''").join(accepted, "vh").select(*ROW_KEY, "start", "end", F.col("new").alias("kind")).distinct()


def _ordered(spans: Column) -> Column:
    """Spans as kind:start:end, by kind as listed, then start."""
    rank = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS)))))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, settings: Bootstrap = Bootstrap(), keep: str = "") -> DataFrame:
    """Row by row: doc_id, base and spans (arrays of kind, start, end), and the
    columns of ``docs`` as ``keep``, if that is named."""
    scanned = materialize(scan(docs, keep), "scan")
    rows = scanned.select(*ROW_KEY, F.explode("found").alias("f")).select(*ROW_KEY, "f.*")
    added = discover(docs, rows, settings).groupBy(*ROW_KEY).agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    added = materialize(added, "added")
    base = F.transform(F.filter("found", lambda s: s["kind"] != ""), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    carried = [keep] if keep else []
    joined = scanned.select("doc_id", *ROW_KEY, base.alias("base"), *carried).join(added, ROW_KEY, "left")
    return joined.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")).alias("spans"), *carried)


def pii(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """Personal data of every document.

    Returns one row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone
    (base spans), base_sha256, spans (base and discovered), n_added. Places are
    code points, ends exclusive. A null or empty text has no spans; texts of any
    length are read whole; repeated rows each get a row; an empty table gives an
    empty result. Spans of one kind never overlap; spans of different kinds may.
    A found value has a digit or an @. Extra columns are not read.
    """
    found = find(docs, settings).withColumn("base_text", _ordered(F.col("base")))
    return found.select(
        "doc_id", *map(_count, KINDS), F.sha2("base_text", 256).alias("base_sha256"),
        _ordered(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def redact(docs: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with every span replaced by its kind, such as ``<EMAIL>``.

    Overlapping spans are replaced together under the first one's kind. n_chars,
    where there is such a column, is that of the new text. Texts without spans,
    null ones included, stay as they are, texts of any length are searched whole,
    repeated rows are treated alike, and an empty table gives an empty one. Columns keep their names, whatever these
    are. Texts are carried beside their spans, so only found values can move
    them.
    """
    found, names = find(docs, settings, keep="whole"), fresh_names(docs, "spans", "done")
    spans = names["spans"]
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    joined = found.select("whole.*", F.when(F.size("spans") > 0, ordered).alias(spans))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("pos"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        after = F.struct(F.concat(acc["out"], between, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"), s["end"].alias("pos"))
        return F.when(s["start"] >= acc["pos"], after).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["pos"], s["end"]).alias("pos")))

    done = names["done"]
    joined = joined.withColumn(done, F.when(F.col(spans).isNotNull(), F.aggregate(spans, start, step)))
    out, pos, clean = F.col(f"{done}.out"), F.col(f"{done}.pos"), F.col(done).isNull()
    tail = F.substring(F.col("text"), (pos + 1).cast("int"), F.length("text"))
    new = {"text": F.when(clean, F.col("text")).otherwise(F.concat(out, tail)).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(clean, F.col("n_chars")).otherwise((F.length(out) + F.length("text") - pos).cast("long")).alias("n_chars")
    return joined.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])


ORACLE = None
