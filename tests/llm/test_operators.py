"""Each operator against brute force on small tables with nulls, empties, ties, repeats and odd texts."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthline.llm import chat_format, decontaminate, kernel, line_dedup, ngram_jaccard, packing, pii, quality_rules, token_counts, toxicity, warc
from hearthline.llm.common import Scratch
from hearthline.llm.components import components

SPACE = " \t\n\x0b\x0c\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with clashing and extra columns: (doc_id, text, score, row, id, n_words)."""
    rng = random.Random(7)
    vocabulary = ["the", "Ede", "éa", "token", "ab", "x", "qué", "Über", "12", "a-b", "中文"]
    base = " ".join(rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(120))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, base), (6, base.upper()), (6, base)]
    words = base.split()
    for k in range(7, 19):
        changed = list(words)
        for _ in range(k - 6):
            changed[rng.randrange(len(changed))] = f"w{rng.randrange(999)}"
        rows.append((k, " ".join(changed)))
    line = "This line of boilerplate is repeated in very many of the documents"
    for k in range(20, 30):
        rows.append((k, "\n".join([" ".join(rng.choice(vocabulary) for _ in range(30)), "  " + (line.upper() if k % 2 else line) + "\t", f"tail {k}", line])))
    rows += [(30, "z" * 200_000), (31, "mail me at ann.b@mail.example.com or +1 (743) 555-3824, 10.0.0.255 and 4111 1111 1111 1111"), (None, base), (32, "long " * 3000)]
    return spark.createDataFrame([(i, t, 0.5, 1, 2, 3) for i, t in rows], "doc_id long, text string, score double, row long, id long, n_words long")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def empty(docs):
    return docs.where("false")


def test_words_and_hashes():
    texts = ["", None, " a b", "é ç\tA a", "a " + "b" * (kernel.BLOCK + 5) + " c", "x"]
    raw, offsets = kernel.utf8(pa.array(texts))
    starts, ends, first = kernel.find_words(raw, offsets, kernel.WHITE)
    for k, text in enumerate(texts):
        assert [raw[starts[i] : ends[i]].tobytes().decode() for i in range(first[k], first[k + 1])] == WORDS.findall(text or "")
    hashes = kernel.hash_words(raw, starts, ends)
    names = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    by = {}
    for name, value in zip(names, hashes):
        assert by.setdefault(lower(name), value) == value
    assert len(set(by.values())) == len(by)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (5, 5)]
    with Scratch(spark, "components") as scratch:
        got = dict(components(spark.createDataFrame(edges, "a long, b long"), scratch).collect())
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}


def shingles(text):
    words = WORDS.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    return sorted(((-1 if i is None else i), len(s), least.get(g, -1)) for (i, _), s, g in zip(rows, sets, label))


@pytest.mark.parametrize("bands", [True, False])
def test_ngram_jaccard(spark, docs, bands, monkeypatch):
    """Without proposals every link must come from the token-group matrix alone."""
    if not bands:
        kept = ngram_jaccard._proposals
        monkeypatch.setattr(ngram_jaccard, "_proposals", lambda reps: kept(reps).where("false"))
    got = ngram_jaccard.near_duplicates(docs).select("id", "n_shingles", "component_id").collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == brute_components(rows_of(docs))


def test_ngram_jaccard_on_shared_boilerplate(spark, monkeypatch):
    """Documents of one template that are too different to link meet at no token; some that do link are found."""
    template = " ".join(f"t{k}" for k in range(204))  # 200 shingles
    own = lambda k, n: " ".join(f"d{k}x{j}" for j in range(n))
    rows = [(k, f"{template} {own(k, 34)}") for k in range(600)] + [(1000 + k, f"{template} {own(1000 + k, 25 - k)}") for k in range(6)]
    met = []
    kept = ngram_jaccard._met
    monkeypatch.setattr(ngram_jaccard, "_met", lambda matrix: met.append(kept(matrix).count()) or kept(matrix))
    got = dict(ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "component_id").collect())
    assert got == {k: 1000 if k >= 1000 else k for k, _ in rows}
    assert met[0] < 100


def test_ngram_jaccard_bound_loses_no_link(spark):
    """The bound over all small sizes, ranges and shared prefix tokens against every partner size."""
    outside = lambda m: -(-4 * m // 5) - 1
    rows, want = [], []
    for n in range(1, 46):
        sizes = range(-(-4 * n // 5), 5 * n // 4 + 1)
        for low in sizes:
            for high in range(low, sizes[-1] + 1):
                for i in range(1, n - outside(n) + 1):
                    rows.append((len(rows), n, i, low, high))
                    want.append(any(180 * (max(outside(n), outside(m)) + i) >= 80 * (n + m) for m in range(low, high + 1)))
    table = spark.createDataFrame(rows, "k long, n long, i long, least long, most long")
    got = {r["k"] for r in table.where(ngram_jaccard._may_link(*map(F.col, ("n", "i", "least", "most")))).select("k").collect()}
    assert got == {k for k, w in enumerate(want) if w}


def test_ngram_jaccard_drops_and_empty(spark, docs):
    kept = ngram_jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {0, 1, 2, 3, 5, 30} and not {r["doc_id"] for r in kept.collect()} & {4, 7, None}
    assert ngram_jaccard.near_duplicates(empty(docs)).count() == 0


def piece_counter():
    """(pieces, unknown) of a word by greedy matching of the model's own pieces over ▁ and the word; other characters are their bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path())
    pieces = {model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    longest = max(map(len, pieces))

    def count(word):
        at, n, unknown, word = 0, 0, 0, "▁" + word
        while at < len(word):
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces), None)
            n += 1 if end else len(word[at].encode())
            unknown |= end is None
            at = end or at + 1
        return n, unknown

    return count


def test_token_counts(spark, docs):
    count = piece_counter()
    got = {(r["doc_id"], r["n_words"], r["n_tokens"], r["n_unknown"]) for r in token_counts.count_tokens(docs).collect()}
    want = set()
    for i, text in rows_of(docs):
        parts = [count(w) for w in WORDS.findall(text or "")]
        want.add((i, len(parts), sum(p[0] for p in parts), sum(p[1] for p in parts)))
    assert got == want
    assert token_counts.count_tokens(empty(docs)).count() == 0


def test_token_counts_of_whole_words(spark):
    """Words that only the lone ▁ or byte pieces can begin, against counts that are written out and against the model's own pieces."""
    count = piece_counter()
    known = {"0810992847249404": (17, 0), "2024": (5, 0), "中文字符测试": (7, 0), "ñ": (2, 0), "\U000130BF": (5, 1), "2\U000130BF4": (7, 1)}
    rng = random.Random(11)
    words = [*known, "▁2"] + ["".join(rng.choice("ab19éñß中▁\U000130BF") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    assert all(count(w) == known[w] for w in known)
    table = spark.createDataFrame(list(enumerate([*words, " ".join(words)])), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["n_unknown"]) for r in token_counts.count_tokens(table).collect()}
    want = [count(w) for w in words]
    assert got == dict(enumerate([*want, (sum(w[0] for w in want), sum(w[1] for w in want))]))


def test_automaton_against_greedy_matching():
    rng = random.Random(3)
    pieces = lambda: ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(8)]
    for _ in range(200):
        heads, tails = pieces(), pieces()
        machine = token_counts.Automaton(heads, tails)
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
            at, n = 0, 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if word[at:e] in (tails if at else heads)), None)
                if end is None:
                    n = token_counts.UNKNOWN + 1
                    break
                at, n = end, n + 1
            assert machine.count(word) == n


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    rows = rows_of(docs)
    packed = packing.pack_documents(docs).collect()
    codec = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, text in rows:
        ids = codec.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want.append((-1 if i is None else i, piece, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())))
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3], r[4]) for r in packed) == sorted(want)
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack_documents(empty(docs)).count() == 0


def test_packing_levels_over_shards(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 2049) for _ in range(900)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long").withColumn("doc_id", F.col("uid"))
    got = packing.pack(pieces, shard_size=200).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(900))
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    # Sizes up to the capacity cannot fill every sequence, so best-fit decreasing over all pieces at once is the measure.
    at_once = len(packing.Shard(np.array(sizes), 2048, 0).built(0.0)[1])
    assert max(fill.values()) <= 2048 and len(fill) <= at_once * 1.02


def test_chunk_encoder_against_the_tokenizer():
    """Ids of mixed words, letter cases, combining marks, punctuation and special tokens, with a cache that is always too small."""
    from tokenizers import Tokenizer

    from hearthline.llm.tokens import ChunkEncoder

    codec, rng = Tokenizer.from_file(packing.tokenizer_path()), random.Random(12)
    encoder = ChunkEncoder(packing.tokenizer_path(), cache=50)
    parts = ["KADİ", "BİLGİ,", "ı", "ß", "ẞ", "é", "E\u0301", "J\u030c", "T\u0308", "H\u0331", "I\u0307", "\u0307", "Σ", "ΑΣ", "ς", "Й", "И\u0306", "中文", "カ\u3099", "ǅ", "ŉ", "K", "½", "٣", "१", "\u00a0", "\u2028", "\x1c", "\x85"]
    parts += ["the", "The", "don't", "I'LL", "x's", "'", "''s", "...", ".", ",", "!?", "#", "$5", "100", "a1b", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\U0001f600", "word", "Œuvre", "naïve.", "fiancé,", "ſ", "ĳ"]
    for size in (1, 3, 8, 40):
        texts = [rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", "", ".", "), ", " ", "\n"]) for _ in range(size)) for _ in range(600)]
        for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == codec.encode(text, add_special_tokens=False).ids, text


def test_packing_search_beats_best_fit(spark):
    """Sizes that best fit packs badly: three fill a sequence exactly. The search finds better bins, whole, in shards and levels."""
    rng = random.Random(4)
    sizes = []
    for _ in range(400):
        a, b = rng.randrange(800, 1000), rng.randrange(530, 600)
        sizes += [a, b, 2048 - a - b]
    best_fit = len(packing.Shard(np.array(sizes), 2048, 0).built(0.0)[1])
    pieces = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long").withColumn("doc_id", F.col("uid"))
    for shard_size in (2000, 150):
        got = packing.pack(pieces, shard_size=shard_size).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(1200))
        fill = {}
        for r in got:
            fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + sizes[r["doc_id"]]
        assert max(fill.values()) <= 2048 and len(fill) < best_fit - 5


def test_packing_children_and_elites():
    """A child holds bins of its second parent whole and every item once; an elite among the seeds is never lost."""
    sizes = np.array([random.Random(k).randrange(300, 1300) for k in range(300)])
    shard = packing.Shard(sizes, 2048, 5)
    a, b = shard.built(0.0), shard.built(0.3)
    for _ in range(20):
        child = shard.child(a, b)
        assert sorted(i for held in child[0] for i in held) == list(range(300))
        assert all(sizes[held].sum() + room == 2048 for held, room in zip(*child, strict=True))
        full = {frozenset(held) for held, room in zip(*b, strict=True) if room <= 32}
        assert full & {frozenset(held) for held in child[0]}
    elite = shard.evolve([])[0]
    after = packing.Shard(sizes, 2048, 9).evolve([packing._load(packing._dump(elite), sizes, 2048)])
    assert packing.Shard.cost(shard, after[0]) <= packing.Shard.cost(shard, elite)
    assert len(elite[1]) < len(a[1])


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(30)) for _ in range(40)]
        if k % 3 == 0:
            words[rng.randrange(40)] = "vilename"
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    rows += [(600, None), (601, ""), (602, "vilename " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (5, None), (None, 1), (0, 1)], "doc_id long, toxic int"))
    got = {r["doc_id"]: (r["score"], r["h"]) for r in toxicity.score(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()}
    assert all(got[k][1] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(600))
    held = [k for k in range(600) if got[k][1]]
    assert sum((got[k][0] >= 0.5) == (k % 3 == 0) for k in held) / len(held) > 0.97
    assert got[600][0] == got[601][0] < 0.5 < got[602][0]
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))[1] == 0.0


def test_toxicity_against_a_plain_fit(spark):
    """Scores against log-count ratios and a regression over n-grams cut from the strings themselves, non-ASCII ones too."""
    rng = random.Random(14)
    stems = ["ärger", "ölig", "größe", "plain", "word", "ñandú", "中文字符测试词", "blümchen"]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(stems) for _ in range(12)] + (["Übelwort"] if k % 2 else ["gutwort"]) * (rng.random() < 0.8)
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, k % 2))
    train = [(t, k % 2) for k, t in rows if zlib.crc32(str(k).encode()) % 5]
    grams = lambda t: {t.lower()[i : i + n] for n in toxicity.GRAMS for i in range(len(t) - n + 1)}
    sets, y = [grams(t) for t, _ in train], np.array([v for _, v in train], float)
    pos, neg, share = {}, {}, y.mean()
    for s, v in zip(sets, y, strict=True):
        for g in s:
            (pos if v else neg)[g] = (pos if v else neg).get(g, 0) + 1
    ratio = {g: np.log((pos.get(g, 0) + toxicity.SMOOTH * share) / y.sum()) - np.log((neg.get(g, 0) + toxicity.SMOOTH * (1 - share)) / (1 - y).sum()) for g in {*pos, *neg}}
    names = [g for g, r in ratio.items() if abs(r) >= toxicity.LEAST_RATIO and pos.get(g, 0) + neg.get(g, 0) >= toxicity.LEAST_COUNT]
    x = np.array([[ratio[g] * (g in s) for g in names] + [1.0] for s in sets])
    w, ridge = np.zeros(len(names) + 1), np.append(np.full(len(names), toxicity.RIDGE * len(sets)), 0.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    want = {k: 1 / (1 + np.exp(-(sum(ratio[g] * v for g, v in zip(names, w) if g in grams(t)) + w[-1]))) for k, t in rows}
    assert max(abs(got[k] - want[k]) for k in got) < 0.03 and {round(v) for v in want.values()} == {0, 1}


def test_toxicity_of_repeated_ids_one_class_and_empty_tables(spark):
    rows = [(k, f"some words {k % 7} here") for k in range(40)] + [(3, "another text"), (3, "a third text"), (3, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__id", F.lit(1)).withColumn("toxic", F.lit("x"))
    both = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    first, second = (toxicity.fit(d, both) for d in (docs, docs.orderBy(F.desc("text"))))
    assert first[1] == second[1] and (first[0] == second[0]).all()
    one = toxicity.fit(docs, both.where("toxic = 1"))
    assert not one[0].any() and one[1] > 0
    none = docs.where("false")
    assert toxicity.score(none, toxicity.fit(none, both)).count() == 0


def test_line_dedup(spark, docs):
    rows = rows_of(docs)
    key = lambda line: lower(line.strip(SPACE))
    holders = {}
    for i, text in rows:
        if i is not None:
            for line in set(map(key, (text or "").split("\n"))):
                if len(line) >= 40:
                    holders.setdefault(line, set()).add(i)
    want = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(holders.get(key(x), ())) < 5 or i == max(holders[key(x)])]
        want.append((-1 if i is None else i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    out = line_dedup.dedup_lines(docs)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()) == sorted(want)
    assert any(w[2] for w in want) and line_dedup.dedup_lines(empty(docs)).count() == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[name]:
                out.append((m.start(), m.end(), kind))
    return sorted(out)


def test_pii_base(spark, docs):
    odd = ["a@b.com_c@d.org x@y 1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1", "é 4111-1111-1111-1111é a.b@c.d.e.", "+1+2+3 +12345678901", "1" * 5000 + " " + "a" * 50_000, "a@b@c.de 1.2.3.", "+1" + "(" * 3000 + "2 "]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    got = [(r["doc"], sorted((s["start"], s["end"], s["kind"]) for s in r["base"])) for r in pii.find_pii(table).collect()]
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    assert sorted(got, key=key) == sorted([(i, pii_spans(t)) for i, t in rows_of(table)], key=key)
    assert pii.find_pii(empty(docs)).count() == 0


def test_pii_discovers_in_confident_contexts(spark):
    seeds = [(k, f"contact user{k}@mail.example.com today please") for k in range(80)]
    rows = [*seeds, (100, "contact user7@localhost today please"), (101, "version user7@localhost today"), (102, "nothing 2024 here")]
    got = {r["doc"]: [(s["start"], s["end"], s["kind"]) for s in r["added"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # The unseen address has another shape than the seeds, so only equal shapes in equal contexts are added.
    assert got[102] == [] and got[0] == []
    same = [*seeds, (100, "contact user7@mail.example.com. today please"), (103, "contact user9@mail.example.c_m today please")]
    assert all(not v for k, v in {r["doc"]: r["added"] for r in pii.find_pii(spark.createDataFrame(same, "doc_id long, text string")).collect()}.items() if k < 80)
    cards = [(k, f"pay with 41111111111111{k:02d} now") for k in range(100)]
    luhn = lambda d: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    known = [(k, t) for k, t in cards if luhn(t.split()[2])]
    unseen = next((k, t) for k, t in cards if not luhn(t.split()[2]))
    many = [(j * 100 + k, t.replace("4111", f"4{j}11")) for j in range(10) for k, t in cards if luhn(t.replace("4111", f"4{j}11").split()[2])]
    out = {r["doc"]: [(s["start"], s["end"], s["kind"]) for s in r["added"]] for r in pii.find_pii(spark.createDataFrame([*many, (5000, unseen[1])], "doc_id long, text string")).collect()}
    assert known and out[5000] == [(9, 25, 2)] and not any(v for k, v in out.items() if k != 5000)


def test_pii_learns_from_spans_of_several_words(spark):
    """Phones with spaces are seeds, at text edges and beside other identifiers too; one with too few digits is found by context."""
    ways = [("call ", " today"), ("", " soon"), ("dial ", ""), ("room a12 ", " please"), ("ring ", " a7 days")]
    rows, want = [(9999, "other words +1 (200) 55-13 elsewhere")], {9999: []}
    for j, (before, after) in enumerate(ways):
        rows += [(100 * j + k, f"{before}+1 ({200 + k}) 555-{7400 + k}{after}") for k in range(40)]
        rows.append((100 * j + 50, f"{before}+1 (200) 55-12{after}"))
        want |= {100 * j + k: [] for k in range(40)} | {100 * j + 50: [(len(before), len(before) + 14, 3)]}
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc"]: [(s["start"], s["end"], s["kind"]) for s in r["added"]] for r in out} == want


def test_pii_scores_against_brute_force(spark):
    rng = random.Random(8)
    kinds = {w: rng.choice([0, 0, 3]) if rng.random() < 0.6 else None for w in range(60)}
    near = {w: kinds[w] if kinds[w] is not None else rng.choice([0, 3]) for w in kinds}
    edges = {(p, w) for w in kinds for p in rng.sample(range(12), 3) if p % 2 == (near[w] == 3) or rng.random() < 0.02}
    able = {}
    for p in range(12):
        seeds = {kinds[w] for q, w in edges if q == p and kinds[w] is not None}
        if len(seeds) == 1 and sum(kinds[w] is not None for q, w in edges if q == p) >= pii.LEAST_SEEDS:
            able[p] = seeds.pop()
    live = {e for e in edges if e[0] in able}
    distrust = dict.fromkeys(able, 1.0)
    for _ in range(pii.ROUNDS):
        trust = {}
        for p in able:
            each = [1.0 if kinds[w] is not None else 1 - np.prod([distrust[q] for q, v in live if v == w and q != p]) for q, w in live if q == p]
            trust[p] = sum(each) / len(each)
        distrust = {p: 1 - min(t, 0.999) for p, t in trust.items()}
    table = spark.createDataFrame([(p, w, kinds[w]) for p, w in edges], "pattern long, word long, kind int")
    patterns, scores = pii.score_graph(table)
    got = {r["pattern"]: (r["as_kind"], r["trust"]) for r in patterns.collect()}
    assert {p: k for p, (k, _) in got.items()} == able and len(able) > 4
    assert all(abs(got[p][1] - (1 - distrust[p])) < 1e-9 for p in able)
    want = {w: 1.0 if kinds[w] is not None else 1 - np.prod([distrust[p] for p, v in live if v == w]) for w in {w for _, w in live}}
    assert {r["word"] for r in scores.collect()} == set(want)
    assert all(abs(r["score"] - want[r["word"]]) < 1e-9 for r in scores.collect())


def test_pii_discovers_planted_secrets(spark):
    """Secrets without the lead that seeds need are found by their form and context; numbers that fail a checksum half the time are not."""
    rng = random.Random(21)
    digest = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, want = [], {}
    for k in range(300):
        held = k % 12 == 0
        value = digest(40)
        text = f"{word()} {word()} \"{value}\" {word()}" if held else f"{word()} token = \"{value}\" {word()}"
        rows.append((k, text))
        want[k] = [(text.index(value), text.index(value) + 40, 4)]
    for k in range(300, 500):  # the context alone: values of many forms after the same two words
        value = digest(rng.randrange(8, 30)) if k % 12 == 0 else "AKIA7" + "".join(rng.choice("ABCXYZ789") for _ in range(15))
        text = f"{word()} user session: {value} {word()}"
        rows.append((k, text))
        want[k] = [(text.index(value), text.index(value) + len(value), 4)]
    rows += [(k, f"{word()} {rng.randrange(10**15, 10**16)} {word()}") for k in range(500, 900)]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc"]: [(s["start"], s["end"], s["kind"]) for s in r["added"]] for r in out}
    assert {k: got[k] for k in want} == want
    assert not any(got[k] for k in range(500, 900))


def test_pii_of_very_many_matches(spark):
    """Places by blocks, in one text with 60,000 matches and a gap longer than any context."""
    text = " ".join(["1.2.3.4", " " * 100, "a@b.cd"] * 30_000)
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert sorted((s["start"], s["end"], s["kind"]) for s in r["base"]) == pii_spans(text)


@pytest.mark.parametrize("files", [warc.FILES, ((10, 3), (300, 2), (1 << 31, 1))])
def test_warc(spark, tmp_path, files, monkeypatch):
    monkeypatch.setattr(warc, "FILES", files)
    big = "<html>" + "x" * 200
    rows = [(3, "http://a b\n", big), (1, None, big), (2, "u", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", big), (7, "WARC/1.1\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 20), (8, "é", "é中\r\n\r\n" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1))
    warc.archive_pages(pages, str(tmp_path / "w"))
    got = sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((x[0] for x in rows if x[0] is not None and x[2] == html), default=None) if len(data) >= 100 else i
        again = first is not None and first != i
        want.append((-1 if i is None else i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want)
    warc.archive_pages(pages.where("false"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_versions(version):
    content = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\nhttp://fake 1 2 3 4\n"
    data = warc.arc_header("f.arc", version)
    data += warc.arc_record("http://x/ y", content, version, "f.arc", len(data)) + warc.arc_record("dns:x", b"", version, "f.arc", 0)
    records = list(warc.parse_arc(data))
    assert [(f["URL"], c) for f, c, _ in records] == [("http://x/%20y", content), ("dns:x", b"")]
    made = warc.to_warc(*records[0][:2], "f.arc:1")
    assert b"WARC-Type: response" in made and b"WARC-Date: 2024-01-01T00:00:00Z" in made and made.endswith(content)
    assert b"WARC-Type: resource" in warc.to_warc(*records[1][:2], "f.arc:2")
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-60]))


def test_quality_base(spark, docs):
    def base(text):
        words = WORDS.findall(text or "")
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in (k, k + 1, k + 2)} if len(grams) < 500 else set(range(len(words)))
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    more = spark.createDataFrame([(200, "a a a a"), (201, "a b a b a"), (202, "a b c d"), (203, "# * a\n# * a\n\n\n"), (204, "a a a")], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    out = quality_rules.judge(table).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    got = sorted(((r["doc"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out), key=key)
    assert got == sorted([(i, *base(t)) for i, t in rows_of(table)], key=key)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(table.where("false")).count() == 0


def test_quality_model_against_brute_force(spark):
    """The determinant that binned concentration reaches, against many random starts with exact subsets; outliers in a cluster don't shift it."""
    rng = np.random.default_rng(3)
    groups = {}
    for g, share in (("a", 0.0), ("b", 0.2)):
        mix = rng.normal(size=(4, 4)) * 0.3 + np.eye(4)
        x = rng.normal(size=(400, 4)) @ mix + [5, 1.5, 0.2, 0.3]
        x[: int(400 * share)] = rng.normal(size=(int(400 * share), 4)) * 0.1 + [9, 7, 6, 5]
        groups[g] = np.rint(x * quality_rules.SCALE).astype(int)
    table = spark.createDataFrame([(g, *map(int, r)) for g, x in groups.items() for r in x], "g string, x0 long, x1 long, x2 long, x3 long")
    got = {r["g"]: r for r in quality_rules.fit_outlier_model(table).collect()}
    floor = np.diag(np.square(quality_rules.FLOORS))
    for g, ints in groups.items():
        x = ints / quality_rules.SCALE
        best = (np.inf, None, None)
        for _ in range(60):
            some = x[rng.choice(len(x), 8, replace=False)]
            mean, cov = some.mean(0), np.cov(some.T, bias=True) + 1e-3 * np.eye(4)
            for _ in range(12):
                d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
                core = x[np.argsort(d)[: int(len(x) * quality_rules.CORE)]]
                mean, cov = core.mean(0), np.cov(core.T, bias=True) * quality_rules.CONSISTENCY + floor
            best = min(best, (np.linalg.slogdet(cov)[1], mean, cov), key=lambda b: b[0])
        assert got[g]["log_det"] < best[0] + 0.35
        assert np.abs(np.array([got[g][f"m{i}"] for i in range(4)]) - best[1]).max() < 0.25
    assert got["b"]["m1"] < 3


def test_quality_keeps_clashing_columns_nulls_and_empty_tables(spark):
    rows = [(k, f"{' '.join('w%d' % (k * 7 % 31 + j * 5 % 97) for j in range(80))}", k) for k in range(100)] + [(None, None, 1), (7, "", 2), (7, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    docs = docs.withColumn("n_words", F.lit("x")).withColumn("d2", F.lit(1)).withColumn("g", F.lit(2)).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    out = quality_rules.filter_quality(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == set(range(100)) - {7} | {7}
    assert quality_rules.filter_quality(docs.where("false")).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 400)))) for k in range(300)]
    rows += [(1000 + k, " ".join(w + "###" for w in t.split())) for k, t in rows[:15]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    kept = {r["doc_id"] for r in quality_rules.filter_quality(docs).collect()}
    assert kept == set(range(300))


def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "\\a<s>\\", "<<s>>[/ROLE]", "", None, "é\n" * 300_000, "[ROLE]x[/ROLE] "]
    rows = [(1, k, ("user", "assistant", "system", "tool", None, "assistant", "[/ROLE]")[k], t) for k, t in enumerate(odd)]
    rows += [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, None, "user", "first"), (2, 0, "assistant", "a"), (None, 0, "user", "x")]
    rows += [(3, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(table)).collect()}
    null = lambda v: (v is not None, v if v is not None else 0)
    for conv in (1, 2, 3, None):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (null(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        all_text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(all_text.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(table.where("false"))).count() == 0


def brute_marks(text, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = pattern.findall(lower(text or ""))
    hit, found = set(), set()
    for item, body in items:
        need = pattern.findall(lower(body or ""))
        size = min(len(need), 10)
        windows = {tuple(need[k : k + size]) for k in range(len(need) - size + 1)} if need and item is not None else set()
        for k in range(len(words) - size + 1):
            if size and tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [2 << 20, 60])
def test_decontamination(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    base = next(t for i, t in rows_of(docs) if i == 5)
    items = [(10, " ".join(base.split()[20:45])), (9, "one"), (8, "mail me"), (7, None), (6, "..."), (10, "one"), (5, "long long long"), (None, "one"), (4, "This LINE of, boilerplate is repeated in very many of the documents!")]
    out = decontaminate.mark_contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert [c for c in docs.columns if c not in out.columns] == []
    key = lambda x: (-1 if x[0] is None else x[0], x[1:])
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in out.collect()), key=key)
    assert got == sorted([(i, *brute_marks(t, items)) for i, t in rows_of(docs)], key=key)
    assert decontaminate.mark_contamination(docs, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def test_decontamination_by_textual_ids(spark, docs):
    base = next(t for i, t in rows_of(docs) if i == 5)
    items = [("b", " ".join(base.split()[20:45])), ("a", " ".join(base.split()[30:60])), ("b", "nowhere to be found"), ("", "one")]
    out = decontaminate.mark_contamination(docs, spark.createDataFrame(items, "item_id string, text string"))
    got = {(r["doc_id"], tuple(r["items"])) for r in out.collect()}
    assert got == {(i, tuple(brute_marks(t, items)[2])) for i, t in rows_of(docs)} and any({"a", "b"} <= set(x) for _, x in got)


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["op1_ngram_jaccard", "op5_line_dedup", "op7_warc", "op9_chat_format", "op10_decontaminate"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    from hearthline.llm import registry

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    found = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda row: tuple(str(v) for v in row)
    assert sorted(map(text, df.select(*names).collect())) == sorted(map(text, found.fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline

    from hearthline.llm.common import materialise

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, DATA), name)
        assert docs.columns == columns and docs.count()
    left = rows_of(docs)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(brute_marks(t, items)[1] for _, t in left[:20])
    sets = [shingles(t) for _, t in left]
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in left}
