"""Personal data by bootstrapped contextual extraction, with SQL functions only.

Base patterns find the seeds: e-mail, IP, card and phone spans, of however many words; words that an
assignment to a credential's name precedes, and cloud access key ids, are seeds of a kind of their own,
``secret``. Every word with a digit or ``@`` and every match of a base pattern that is not valid is a
possible identifier; a word that holds a seed is one too. Its lexical patterns are (a) the word before,
the word after and its own shape, (b) the two words before and what leads it in, (c) its form: its
leading name, kind of characters and length. The edge of a text and a neighbouring identifier (by its
shape) are contexts as well. Patterns are scored by the seeds among the different identifiers they
surround, identifiers by the patterns they occur in, in turn, on a graph that only holds patterns with
enough seeds. Identifiers that confident patterns surround are added to the spans. Texts are read once
and never shuffled; identifiers and patterns are 64-bit hashes in the graph.

The regular expressions are the contract's, written so that the engine cannot backtrack: possessive
repeats, and a look-behind that lets a match start only where the leftmost one could.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import SPACE, let, materialise

KINDS = ("email", "ip", "card", "phone")
#: All kinds of spans; those after ``KINDS`` are never base spans.
ALL_KINDS = (*KINDS, "secret")
# The base patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"[^\x20\x09-\x0D]"
#: A word that holds a digit or an @, from its beginning to its end.
IDENTIFIER = rf"(?<!{WORD})[^\x20\x09-\x0D0-9@]*+[0-9@]{WORD}*+"
#: Names of credentials, as the end of what precedes a value, and values that say themselves what they are.
SECRET_LEAD = r"(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key)[\x20\x22\x27]?[=:]+[\x20\x22\x27]*$"
SECRET_VALUE = r"^A(?:KIA|SIA)[0-9A-Z]{16}$"
SECRET_CHARS = 8
#: Characters that are cut from a word's ends, and so many of a neighbouring word (or shape) make a context.
OPENING, CLOSING, CONTEXT = "\"'([{<#*$%&|", "\"'.,;:!?)]}>#*$%&|", 40
ROUNDS, LEAST_SEEDS, CONFIDENT, SALTS = 3, 5, 0.9, 16
SPANS = "array<struct<start:int,end:int,kind:int>>"
CANDIDATES = "array<struct<start:int,end:int,word:bigint,patterns:array<bigint>,kind:int>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.ltrim(p, F.lit("0")), lambda d: (F.length(d) <= 3) & (F.coalesce(d.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return let(_digits(match), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _places(cells: Column) -> Column:
    """(start, end) of matches from their (gap, size) in order: running sums, by blocks of about the square root of their number."""
    kind = "array<struct<start:int,end:int>>"
    none = F.array().cast(kind)

    def run(block: Column) -> Column:
        step = lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end")))).alias("out"),
        )
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def joined(runs: Column) -> Column:
        before = F.aggregate(
            runs,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )
        shifted = lambda r, by: F.transform(r["out"], lambda p: F.struct((p["start"] + by).alias("start"), (p["end"] + by).alias("end")))
        return F.flatten(F.zip_with(runs, before, shifted))

    step = F.ceil(F.sqrt(F.size(cells))).cast("int")
    blocks = let(step, lambda k: F.transform(F.sequence(F.lit(1), F.size(cells), k), lambda at: F.slice(cells, at, k)))
    return F.when(F.size(cells) == 0, none).otherwise(let(F.transform(blocks, run), joined))


def _located(text: Column, pattern: str, more) -> Column:
    """Matches in order with code-point places: array of (start, end, x); ``more(found, parts, m, i)`` makes x.

    The text between the matches comes from splitting at the same pattern.
    """

    def place(found: Column, parts: Column) -> Column:
        cells = F.transform(found, lambda m, i: F.struct(F.char_length(F.get(parts, i)).alias("gap"), F.char_length(m).alias("size")))
        extra = F.transform(found, lambda m, i: more(found, parts, m, i))
        return let(cells, lambda c: F.zip_with(_places(c), extra, lambda p, x: F.struct(p["start"].alias("start"), p["end"].alias("end"), x.alias("x"))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda f: let(F.split(text, pattern, -1), lambda parts: place(f, parts)))


def _matches(text: Column, kind: str) -> Column:
    """All matches of a base pattern as candidates; kind is null where a match is not valid."""
    order = F.lit(KINDS.index(kind))
    found = _candidates(text, PATTERNS[kind], lambda m, _: F.when(_valid(kind, m), order), whole=True)
    possible = text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
    return F.when(possible, found).otherwise(F.array().cast(CANDIDATES))


def _shape(word: Column) -> Column:
    """Digits as 9, letters as a, runs of each as one."""
    return F.regexp_replace(F.regexp_replace(word, "[0-9]+", "9"), "[A-Za-z]+", "a")


def _form(core: Column) -> Column:
    """The kind of characters and the length of a word of letters and digits; of others each digit as 9 and runs of letters as a."""
    size = F.char_length(core).cast("string")
    out = F.left(F.regexp_replace(F.regexp_replace(core, "[0-9]", "9"), "[A-Za-z]+", "a"), F.lit(CONTEXT))
    for name, pattern in (("m", "^[0-9A-Za-z]+$"), ("u", "^[0-9A-Z]+$"), ("h", "^[0-9a-f]+$|^[0-9A-F]+$"), ("d", "^[0-9]+$")):
        out = F.when(core.rlike(pattern), F.concat(F.lit(name), size)).otherwise(out)
    return out


def _last_words(gap: Column) -> Column:
    """(one, two): the last word of a text and the one before it, empty where there is none."""
    plain = F.rtrim(F.translate(gap, SPACE, " " * len(SPACE)), F.lit(" "))
    one = lambda t: F.substring_index(t, " ", -1)
    rest = lambda t: F.rtrim(F.left(t, F.char_length(t) - F.char_length(one(t))), F.lit(" "))
    return let(plain, lambda t: F.struct(F.right(one(t), F.lit(CONTEXT)).alias("one"), F.right(one(rest(t)), F.lit(CONTEXT)).alias("two")))


def _first_word(gap: Column) -> Column:
    plain = F.ltrim(F.translate(gap, SPACE, " " * len(SPACE)), F.lit(" "))
    return F.left(F.substring_index(plain, " ", 1), F.lit(CONTEXT))


def _candidates(text: Column, pattern: str, kind, whole: bool = False) -> Column:
    """Matches of a pattern as (start, end, word, patterns, kind); ``kind(core, lead)`` says which are seeds.

    Unless ``whole``, what leads a match in (a name and an assignment, opening marks) and closing marks
    are not part of the span. A context is the next word, else the neighbouring match, else nothing at an edge.
    """
    plain = lambda side: F.lower(F.regexp_replace(side, "[0-9]+", "9"))

    def parted(m: Column) -> Column:
        """(lead, core) of a match."""
        if whole:
            return F.struct(F.lit("").alias("lead"), m.alias("core"))
        key = lambda w: F.regexp_extract(w, "^[A-Za-z_][A-Za-z_.-]*+[=:]++", 0)
        rest = let(F.ltrim(m, F.lit(OPENING)), lambda w: F.ltrim(F.substr(w, F.char_length(key(w)) + 1), F.lit(OPENING)))
        cut = lambda r: F.struct(F.left(m, F.char_length(m) - F.char_length(r)).alias("lead"), F.rtrim(r, F.lit(CLOSING)).alias("core"))
        kept = lambda p: F.when(p["core"].rlike("[0-9@]"), p).otherwise(F.struct(F.lit("").alias("lead"), m.alias("core")))
        return let(let(rest, cut), kept)

    def seen(found: Column, parts: Column, m: Column, i: Column) -> Column:
        before, after = _last_words(F.get(parts, i)), _first_word(F.get(parts, i + 1))
        beside = lambda k, side: _shape(side(F.coalesce(F.get(found, k), F.lit("")), F.lit(CONTEXT)))

        def made(left: Column, right: Column, part: Column) -> Column:
            one = F.when(left["one"] != "", plain(left["one"])).otherwise(beside(i - 1, F.right))
            next_ = F.when(right != "", plain(right)).otherwise(beside(i + 1, F.left))
            lead = F.lower(F.concat_ws(" ", left["two"], left["one"], part["lead"]))
            patterns = F.array(
                F.xxhash64(F.lit("a"), one, next_, F.lower(_shape(m))),
                F.xxhash64(F.lit("b"), plain(left["two"]), one, plain(part["lead"])),
                F.xxhash64(F.lit("c"), plain(part["lead"]), _form(part["core"])),
            )
            if whole:  # a piece of a longer word is no identifier
                begins = F.right(F.get(parts, i), F.lit(1)).rlike(r"^[\x20\x09-\x0D\x22\x27(\[{<=:]?$")
                ends = F.left(F.get(parts, i + 1), F.lit(1)).rlike(r"^[\x20\x09-\x0D\x22\x27)\]}>.,;:!?]?$")
                patterns = F.when(begins & ends, patterns).otherwise(F.array().cast("array<bigint>"))
            return F.struct(
                F.char_length(part["lead"]).alias("skip"), F.char_length(part["core"]).alias("size"), F.xxhash64(part["core"]).alias("word"), patterns.alias("patterns"), kind(part["core"], lead).alias("kind")
            )

        return let(F.struct(before.alias("left"), after.alias("right"), parted(m).alias("part")), lambda c: made(c["left"], c["right"], c["part"]))

    def span(s: Column) -> Column:
        start = s["start"] + s["x"]["skip"]
        return F.struct(start.alias("start"), (start + s["x"]["size"]).alias("end"), s["x"]["word"].alias("word"), s["x"]["patterns"].alias("patterns"), s["x"]["kind"].cast("int").alias("kind"))

    return F.transform(_located(text, pattern, seen), span)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(ordered, text), ",")


def _seed_kind(word: Column, lead: Column) -> Column:
    """The kind of a word that holds a base match of its own, or that is a secret by its form or what leads it in, else null."""
    secret = word.rlike(SECRET_VALUE) | ((F.char_length(word) >= SECRET_CHARS) & lead.rlike(SECRET_LEAD))
    out = F.when(secret, F.lit(ALL_KINDS.index("secret")))
    for order in reversed(range(len(KINDS))):
        kind = KINDS[order]
        found = F.regexp_extract_all(word, F.lit(PATTERNS[kind]), F.lit(0))
        hit = F.exists(found, partial(_valid, kind))
        if NEEDS[kind]:
            hit = word.contains(NEEDS[kind]) & hit
        out = F.when(hit, F.lit(order)).otherwise(out)
    return out


def score_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns: pattern, as_kind, trust), (identifiers: word, score) from different edges (pattern, word, kind), kind null but for seeds.

    Only patterns with ``LEAST_SEEDS`` seeds, all of one kind, take part. A pattern's trust is the mean
    of what its identifiers vouch for: a seed 1, another identifier its score by its other patterns
    alone, so no pattern confirms itself. A score is 1 less the product of its patterns' distrusts,
    each at least 0.001. All trust is 0 before the first of ``ROUNDS`` rounds.
    """
    seeds = edges.where("kind is not null").groupBy("pattern").agg(F.count("*").alias("seeds"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    able = seeds.where((F.col("seeds") >= LEAST_SEEDS) & (F.col("low") == F.col("high"))).select("pattern", F.col("low").alias("as_kind"))
    salt = F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    # A very common pattern is dealt to SALTS tasks. ``doubt`` is the logarithm of the pattern's distrust.
    graph = edges.withColumn("salt", salt).join(able.withColumn("salt", salts), ["pattern", "salt"])
    graph = materialise(graph.withColumn("doubt", F.lit(0.0)), "pii-graph")
    for _ in range(ROUNDS):
        total = graph.groupBy("word").agg(F.sum("doubt").alias("total"))
        vouched = F.when(F.col("kind").isNotNull(), 1.0).otherwise(1.0 - F.exp(F.col("total") - F.col("doubt")))
        trust = graph.join(total, "word").groupBy("pattern").agg(F.avg(vouched).alias("trust"))
        trust = trust.select("pattern", salts.alias("salt"), F.log1p(-F.least(F.col("trust"), F.lit(0.999))).alias("doubt"))
        graph = materialise(graph.drop("doubt").join(trust, ["pattern", "salt"]), "pii-graph")
    patterns = graph.groupBy("pattern", "as_kind").agg((1.0 - F.exp(F.min("doubt"))).alias("trust"))
    scores = graph.groupBy("word").agg(F.when(F.max("kind").isNotNull(), 1.0).otherwise(1.0 - F.exp(F.sum("doubt"))).alias("score"))
    return patterns, scores


def _discover(words: DataFrame) -> DataFrame:
    """(row, start, end, kind) of identifiers that confident patterns surround, and of secrets, from candidates (row, start, end, word, patterns, kind)."""
    known = words.select("row", "start", "end", "word", "kind", F.explode("patterns").alias("pattern"))
    # Different identifiers of each pattern; partial aggregation keeps a very common pattern in many tasks.
    edges = known.groupBy("pattern", "word").agg(F.max("kind").alias("kind"))
    patterns, scores = score_graph(edges)
    trusted = patterns.where(F.col("trust") >= CONFIDENT).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = known.where("kind is null").withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
    found = open_.join(trusted, ["pattern", "salt"]).join(scores.where(F.col("score") >= CONFIDENT), "word")
    found = found.groupBy("row", "start", "end").agg(F.max_by("as_kind", "trust").alias("kind"))
    return found.unionByName(words.where(F.col("kind") >= len(KINDS)).select("row", "start", "end", "kind"))


def _apart(added: DataFrame, table: DataFrame) -> DataFrame:
    """(row, more): added spans that overlap no base span and lie in no other added one, in order."""
    base = table.select("row", F.explode("base").alias("b")).join(added.select("row").distinct(), "row", "left_semi")
    spans = added.withColumn("own", F.lit(0)).unionByName(base.select("row", "b.start", "b.end", "b.kind", F.lit(1).alias("own")))
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("own"), "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), "end").rowsBetween(Window.unboundedPreceding, -1)
    base_end = F.max(F.when(F.col("own") == 1, F.col("end"))).over(before)
    base_start = F.min(F.when(F.col("own") == 1, F.col("start"))).over(after)
    spans = spans.withColumn("base_end", base_end).withColumn("any_end", F.max("end").over(before)).withColumn("base_start", base_start)
    clear = (F.col("start") >= F.coalesce("base_end", F.lit(0))) & (F.col("end") <= F.coalesce("base_start", F.col("end"))) & (F.col("end") > F.coalesce("any_end", F.lit(0)))
    return spans.where((F.col("own") == 0) & clear).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("more"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, base, added): base spans and added spans (start, end, kind) of every row.

    Places are code points, ends exclusive. Null texts are empty; rows that repeat are searched each;
    rows without an id are searched too; an empty table gives an empty result. Added spans never
    overlap base ones, and none lies in another.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    may = F.col("text").rlike("[0-9@]")
    none = F.array().cast(CANDIDATES)
    table = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    matches = F.concat(*[_matches(F.col("text"), k) for k in KINDS])
    words = _candidates(F.col("text"), IDENTIFIER, _seed_kind)
    table = table.select("doc", "version", "row", F.when(may, matches).otherwise(none).alias("matches"), F.when(may, words).otherwise(none).alias("words"))
    valid = F.filter("matches", lambda w: w["kind"].isNotNull())
    base = F.transform(valid, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["kind"].alias("kind")))
    table = materialise(table.select("doc", "version", "row", base.alias("base"), F.concat("words", "matches").alias("words")), "pii")
    added = materialise(_discover(table.select("row", F.explode("words").alias("w")).select("row", "w.*")), "pii-added")
    joined = table.drop("words").join(_apart(added, table), "row", "left")
    return joined.select("doc", "version", "base", F.coalesce("more", F.array().cast(SPANS)).alias("added"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and the counts of added and of all spans of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return find_pii(docs).select(
        F.col("doc").alias("doc_id"), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans")
    )
