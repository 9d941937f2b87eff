"""Personal data by regular patterns and by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns give spans of four kinds. Together with seeds of a fifth (secrets of known form) they start a
bootstrap over identifier-like candidates. The lexical patterns of a span or candidate are the two words before it,
the one word before it if that ends in a sign (as in ``tel:``), and one word before with the one after; its text is an instance. Patterns
and instances form a bipartite graph, aggregated before any join. In each round a
pattern is scored for a kind by the share of its different instances that are known to be of that kind;
confident patterns with enough support make their other instances known, which scores further patterns, until
a round makes nothing known.
Tokens under a confident pattern whose shape suits the kind are added to the base spans, seeds of secrets included.

The regular expressions can't backtrack over long runs: each may begin only where a run begins,
and loops over groups are bounded or replaced by one class after marking separators. Positions are running sums over
blocks of matches, and the words around a match come from its neighbours, so cost grows with the text and not with
its square.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.runtime import cut

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
#: Stand for a card's single separators and for the dots inside a domain; both are put out of the text first.
SEP, DOT = "\ue000", "\ue001"
_LOCAL = rf"A-Za-z0-9._%+\-{DOT}"
#: Each pattern finds what the kind's plain pattern finds, from left to right.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+{DOT}[A-Za-z0-9{DOT}-]+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{SEP}])[0-9](?:{SEP}?[0-9]){{11,18}}(?![0-9{SEP}])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Seeds of secrets: hexadecimal tokens of 40 digits and keys with a known beginning.
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{40}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,})(?![A-Za-z0-9])"
#: Candidates: numbers with separators between digits, or words with a digit, an @ or an opening bracket.
TOKEN = r"(?<![\w@.+-])\+?\(?[0-9](?:[ ().-]{0,2}[0-9])*+(?![\w@])|(?<!\S)[^\s0-9@\[({]*+[0-9@\[({]\S*+"
OPENING = " ([{<\"'"
TRIM = ".,;:!?\"'()<>[]{}#%&*$|="
BLOCK = 128


def _sums(part: Column) -> Column:
    """Running sums of a short array of long numbers."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(part, zero, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)), lambda acc: F.slice(acc, F.lit(2), F.size(acc)))


def _tail(gap: Column) -> Column:
    """The last two words of a text and what opens the next one."""
    flat = F.translate(gap, "\n\t\r", "   ")
    bare = F.rtrim(flat, F.lit(OPENING))
    return F.concat(F.substring_index(bare, " ", -2), F.substring(flat, F.length(bare) + 1, F.length(flat)))


def _head(gap: Column) -> Column:
    return F.substring_index(F.ltrim(F.translate(gap, "\n\t\r", "   ")), " ", 1)


def with_spans(rows: DataFrame, searches: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with an array of (start, end, found, before, after) for each search name: (text column, pattern).

    Places are code points; before has the last two words before a match (and more where matches stand there), after the next word.
    Each step is a column of its own that the next one uses more than once, so the optimiser keeps it and nothing is computed twice; running sums go by blocks, so few sums are copied often.
    """
    none = F.array()
    each = lambda made: {f"_{n}_{k}": c for k in searches for n, c in made(k)}
    col = lambda n, k: F.col(f"_{n}_{k}")
    rows = rows.withColumns(each(lambda k: [("found", F.regexp_extract_all(F.col(searches[k][0]), F.lit(searches[k][1]), F.lit(0)))]))
    rows = rows.withColumns(each(lambda k: [("gaps", F.when(F.size(col("found", k)) > 0, F.split(F.col(searches[k][0]), searches[k][1], -1)).otherwise(none.cast("array<string>")))]))
    length = lambda k: F.transform(col("found", k), lambda m, i: (F.length(m) + F.length(F.get(col("gaps", k), i))).cast("long"))
    rows = rows.withColumns(each(lambda k: [("steps", length(k)), ("around", F.transform(col("gaps", k), lambda g: F.struct(_tail(g).alias("tail"), _head(g).alias("head"))))]))
    cuts = lambda k: F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(col("steps", k)) - 1) / BLOCK).cast("int")))
    rows = rows.withColumns(each(lambda k: [("parts", F.transform(cuts(k), lambda i: _sums(F.slice(col("steps", k), i * BLOCK + 1, F.lit(BLOCK)))))]))
    zero = F.lit(0).cast("long")
    tops = lambda k: _sums(F.transform(col("parts", k), lambda y: F.coalesce(F.get(y, F.size(y) - 1), zero)))
    offsets = lambda k: F.slice(F.concat(F.array(zero), tops(k)), F.lit(1), F.size(col("parts", k)))
    # Arguments of zip_with are computed once; what a lambda only refers to may be computed for each element.
    rows = rows.withColumns(each(lambda k: [("ends", F.flatten(F.zip_with(col("parts", k), offsets(k), lambda y, o: F.transform(y, lambda v: v + o))))]))

    def span(k: str):
        def one(m: Column, i: Column) -> Column:
            end = F.get(col("ends", k), i)
            tail = lambda n: F.coalesce(F.get(col("around", k), i - n)["tail"], F.lit(""))
            match = lambda n: F.coalesce(F.get(col("found", k), i - n), F.lit(""))
            back = [tail(2), match(2), tail(1), match(1), tail(0)]
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found"), F.concat(*back).alias("before"), F.get(col("around", k), i + 1)["head"].alias("after"))

        return one

    rows = rows.withColumns({k: F.transform(col("found", k), span(k)) for k in searches})
    return rows.drop(*[f"_{n}_{k}" for k in searches for n in ("found", "gaps", "steps", "around", "parts", "ends")])


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        low = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        fits = lambda p: low(p) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(found, r"\."), fits)
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _kept(number: int, kind: str, spans: Column) -> Column:
    valid = F.filter(spans, lambda x: _valid(kind, x["found"]))
    plain = lambda c: F.translate(c, SEP + DOT, " .")
    return F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), plain(x["found"]).alias("found"), plain(x["before"]).alias("before"), plain(x["after"]).alias("after")))


def _marked(text: Column) -> dict[str, Column]:
    """What each search looks at: the text, with marks for the separators of its kind; empty where the kind can't occur."""
    clean = F.when(text.contains(SEP) | text.contains(DOT), F.translate(text, SEP + DOT, "\ufffd\ufffd")).otherwise(text)
    return {
        "email": F.when(clean.contains("@"), F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)).otherwise(F.lit("")),
        "card": F.when(clean.rlike("[0-9](?:[ -]?[0-9]){11}"), F.regexp_replace(clean, r"(?<=[0-9])[ -](?=[0-9])", SEP)).otherwise(F.lit("")),
    }


def _candidate(x: Column) -> Column:
    start = x["start"] + F.length(x["found"]) - F.length(F.ltrim(x["found"], F.lit(TRIM)))
    bare = F.btrim(x["found"], F.lit(TRIM))
    return F.struct(start.alias("start"), F.lit(None).cast("int").alias("kind"), (start + F.length(bare)).alias("end"), bare.alias("found"), x["before"].alias("before"), x["after"].alias("after"))


def tokens(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``base``, the base spans (start, kind number, end) by start, then kind, and ``tokens``, an array of
    (start, kind or null, end, found, before, after): base spans, seeds of secrets, and candidates without a kind."""
    rows = rows.withColumns({f"_in_{k}": c for k, c in _marked(F.col(text_col)).items()})
    where = {k: (f"_in_{k}" if f"_in_{k}" in rows.columns else text_col, PATTERNS.get(k, SECRET)) for k in KINDS}
    rows = with_spans(rows, where | {"token": (text_col, TOKEN)})
    rows = rows.withColumn("seeds", F.concat(*[_kept(n, k, F.col(k)) for n, k in enumerate(KINDS)]))
    base = F.transform(F.filter("seeds", lambda x: x["kind"] < BASE), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    rows = rows.withColumns({"base": F.array_sort(base), "tokens": F.concat("seeds", F.transform("token", _candidate))})
    return rows.drop("seeds", "token", *KINDS, *[f"_in_{k}" for k in KINDS])


def patterns(before: Column, after: Column) -> Column:
    """Array of the lexical patterns of a place. Brackets and quotes that open it don't count as words."""
    near = F.lower(F.ltrim(F.rtrim(F.translate(before, "\n\t\r", "   "), F.lit(OPENING))))
    two, one = F.substring_index(near, " ", -2), F.substring_index(near, " ", -1)
    both = F.concat(one, F.lit(" _ "), F.lower(F.ltrim(after, F.lit(TRIM))))
    return F.filter(F.array_distinct(F.array(F.when(two.contains(" "), two), F.when(one.rlike(r"[^\p{L}\p{N}]$"), F.concat(one, F.lit(" _"))), F.when((one != "") & (after != ""), both))), lambda p: p.isNotNull())


def _suits(kind: Column, instance: Column) -> Column:
    """Whether a token has the shape of a kind, loosely: an address has an @ or a spelt-out one, a secret letters and digits in one long word, the others enough digits."""
    digits = F.length(F.regexp_replace(instance, "[^0-9]", ""))
    return F.when(kind == 0, instance.rlike(r"@|[\[({ ]at[\])} ]")).when(kind == 1, instance.rlike(r"^[0-9a-f]{1,4}([.:][0-9a-f]{0,4}){3,7}$")).when(kind == 2, digits.between(12, 19)).when(kind == 4, instance.rlike(r"^(?=\D*\d)(?=[^a-z]*[a-z])[\w+/=-]{20,}$")).otherwise(digits.between(7, 15))


def bootstrap(graph: DataFrame, support: int = 3, confidence: float = 0.8, rounds: int | None = None) -> DataFrame:
    """(pattern, kind): the confident patterns, from edges (pattern, instance, kind or null).

    A pattern is confident for a kind if at least ``support`` different instances and a share of ``confidence`` of
    all its different instances are known to be of it. Rounds end when nothing changes, or after ``rounds``: what is
    known only grows, and its kinds only fall.
    """
    edges = cut(graph.where("pattern <> ''").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    known = edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
    good, last = None, None
    for n in itertools.count():
        known = cut(known, "pii-known")
        state = known.agg(F.count("*"), F.sum("kind")).first()
        if good is not None and (state == last or n == rounds):
            break
        last = state
        scored = edges.select("pattern", "instance").join(known, "instance", "left")
        scored = scored.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
        whole = scored.groupBy("pattern").agg(F.sum("n").alias("all"))
        good = scored.where(f"kind is not null and n >= {support}").join(whole, "pattern").where(F.col("n") >= F.col("all") * confidence).select("pattern", F.col("kind").alias("learned"))
        good = cut(good, "pii-patterns")
        found = edges.join(good, "pattern").where(_suits(F.col("learned"), F.col("instance"))).select("instance", F.col("learned").alias("kind"))
        known = known.unionByName(found).groupBy("instance").agg(F.min("kind").alias("kind"))
    return good


def listing(spans: Column) -> Column:
    """kind:start:end of (start, kind, end) in order, joined by commas."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, base, spans) for every row: arrays of (start, kind number, end) in code points, ends exclusive, sorted.

    ``spans`` holds the base spans and what the bootstrap adds; nothing added overlaps a base span. Null texts
    count as empty; rows that repeat are returned each. Further columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    rows = cut(tokens(rows, "text").select("rid", "doc_id", "base", "tokens"), "pii-rows")
    seen = rows.where(F.size("tokens") > 0).select("rid", F.explode("tokens").alias("t")).select("rid", "t.*")
    by_place = Window.partitionBy("rid").orderBy("start", "end", "kind")
    known = F.col("kind").isNotNull()
    before = F.max(F.when(known, F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    backwards = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    after = F.min(F.when(known, F.col("start"))).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("clear", (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))).where(known | F.col("clear"))
    seen = seen.select("rid", "start", "end", "kind", F.lower("found").alias("instance"), patterns(F.col("before"), F.col("after")).alias("patterns"))
    seen = cut(seen, "pii-tokens")
    at = lambda *c: seen.select(*c, F.explode("patterns").alias("pattern"))
    good = bootstrap(at("instance", "kind").select("pattern", "instance", "kind"), **options)
    more = at("rid", "start", "end", "kind", "instance").where(f"kind is null or kind >= {BASE}").join(good, "pattern").where(_suits(F.col("learned"), F.col("instance")))
    more = more.groupBy("rid", "start", "end").agg(F.min("learned").alias("learned")).groupBy("rid").agg(F.collect_list(F.struct("start", F.col("learned").alias("kind"), "end")).alias("more"))
    out = rows.select("rid", "doc_id", "base").join(more, "rid", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return out.select("doc_id", "base", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans): base counts, the hash of the base listing, all spans and their number."""
    count = lambda n: F.size(F.filter("base", lambda x: x["kind"] == n)).cast("long")
    return found.select("doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:BASE])], F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
