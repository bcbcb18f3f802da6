"""Corpus operators against brute force, exact round trips and held-out rows."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import decontamination, exact_dedup, gated_lm, ordinal, packing, secret_scan, sharding, url_rules
from lamina.llm.queries import tokenizer_path

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_urls(spark):
    r = random.Random(5)
    labels = ["a", "b", "ab", "com", "net", "x-y", "en"]
    host = lambda most: ".".join(r.choice(labels) for _ in range(r.randrange(1, most)))
    path = lambda: "/" + "".join(r.choice(labels) + r.choice(["/", "", "/"]) for _ in range(r.randrange(3)))
    rules = sorted({(host(4), path(), r.choice(["allow", "block"])) for _ in range(60)})
    urls = [r.choice(["http://", "HTTPS://", "x://"]) + (h.upper() if r.random() < 0.2 else h) + r.choice(["", path(), path() + "?q=/en/", path() + "#f"]) for h in (host(6) for _ in range(1500))]
    urls += [None, "", "no scheme", "://", "a://b://c/en", "http://é.com/\n/", "http://com", "http://.com/", "http://com./"]
    pages = list(enumerate(urls)) + [(0, urls[0])]

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        name = re.match(r"[^/?#]*", rest).group()
        where = re.match(r"[^?#]*", rest[len(name):]).group()
        name = name.translate(LOWER)
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if ("." + name).endswith("." + h) and where.startswith(p)]
        best = max(fits, default=(0, 0, False, None, "allow"))
        return name, where, best[3], best[4]

    got = url_rules.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    rows = [(x["page_id"], x["host"], x["path"], x["rule"] or "", x["verdict"]) for x in got.collect()]
    want = [(k, *(v or "" for v in judge(u))) for k, u in pages]
    assert sorted(rows) == sorted(want)


def test_secrets(spark):
    r = random.Random(6)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", "paſſword", "=", ":", " = ", '"', "'", "\n", " ", "é😀", "abcdefgh", "short", "AKIA", "AKIA" + "Z9" * 6,
             "0123456789abcdef" * 2, "ghp_" + "a1" * 18, "xoxb-" + "1" * 12, "AIza" + "x" * 35, "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(800)] + [None, "x" * 200_000 + "token=abcdefgh"]
    rules = secret_scan.BASE + secret_scan.MORE

    def scan(text):
        found = [(m.start(), rank, m.end(), rule.kind) for rank, rule in enumerate(rules)
                 for m in re.finditer(rule.pattern, text or "", re.ASCII | (re.IGNORECASE if rule.any_case else 0)) if len(m.group(rule.group)) >= rule.least]
        return sorted(found)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: [tuple(s) for s in x["found"]] for x in secret_scan.scan_secrets(df).collect()}
    assert got == {k: scan(t) for k, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 500


@pytest.mark.parametrize("counters,heavy", [(1, 1), (3, 2), (512, 4096)])
def test_exact_copies(spark, monkeypatch, counters, heavy):
    monkeypatch.setattr(exact_dedup, "COUNTERS", counters)
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    r = random.Random(7)
    texts = ["".join(r.choice(["a", "b", "é", " ", "\t", "\n", "\u00a0"]) for _ in range(r.randrange(7))) for _ in range(700)] + [None, "", "x" * 90_000]
    texts = [t if r.random() < 0.6 else "hot text" + " " * r.randrange(3) for t in texts]
    groups = defaultdict(list)
    for k, text in enumerate(texts):
        groups[(text or "").translate({ord(c): None for c in BLANKS})].append((-len(text or ""), k))
    want = sorted((k, min(own)[1], len(own), min(own)[1] == k) for own in groups.values() for _, k in own)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert sorted(tuple(x)[:4] for x in exact_dedup.exact_dedup(df).collect()) == want
    assert sorted(x["doc_id"] for x in exact_dedup.keep_distinct(df).collect()) == [k for k, _, _, kept in want if kept]


@pytest.mark.parametrize("items", [30, 100_000])
def test_packing_round_trip(spark, monkeypatch, items):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "ITEMS", items)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    r = random.Random(8)
    words = ["the", "The", "naïve", "NAÏVE", "co-op", "it's", "x=1;", "3.14", "…", "日本語", "e\u0301", "\u200b", "\x00", "\ufffd", "[SEP]", "<s>", "</s>", "\t", "\r\n", "\n\n", "  ", "\u00a0", "ﬁ", "İ", "ß!", "word.", "?!", "a,b"]
    texts = [r.choice([" ", "", " "]).join(r.choice(words) for _ in range(r.randrange(25))) for _ in range(400)] + [None, "", " ", "long words " * 400]
    tokenizer, capacity = Tokenizer.from_file(tokenizer_path()), 64
    want = []
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], "<u4")
            want.append((k, piece, at, len(part), zlib.crc32(part.tobytes())))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = packing.pack_documents(df, tokenizer_path(), capacity).collect()
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in rows) == want
    bins = defaultdict(list)
    for x in rows:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= capacity
    assert len(bins) <= 1.1 * math.ceil(sum(w[3] for w in want) / capacity) + 1


def test_encoder_is_the_tokenizer(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    r, tokenizer = random.Random(11), Tokenizer.from_file(tokenizer_path())
    # a capital that lower-cases to a letter and a mark goes together with the punctuation after it
    alphabet = [*"aBéÉßÿŸ×÷İıſÅ'*&<|1½²ªµж漢한ﬁǅ.,!_- \n\t\r\x85\u00a0\u200d\u0301", "'s", "'re", "<|endoftext|>", "ΑΣ", "word"]
    texts = ["İ.", "ÿİ* a", "", *("".join(r.choice(alphabet) for _ in range(r.randrange(14))) for _ in range(4000))]
    want = [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    encoder = packing.Encoder(tokenizer_path(), bound=50)
    got = [ids for k in range(0, len(texts), 500) for ids in encoder(pa.array(texts[k:k + 500]))]
    assert got == want
    # words and the punctuation after them are encoded apart, so each is encoded once
    asked = []
    encoder = packing.Encoder(tokenizer_path())
    monkeypatch.setattr(encoder, "_encode", lambda text: asked.append(text) or b"")
    encoder(pa.array(["Straße*** straße&&& STRASSE*** x", None, "là*** où&&&"]))
    assert sorted(asked) == ["&&&", "***"]


def test_words_as_a_column():
    import pyarrow as pa

    from lamina.llm.words import distinct_words, words_of

    r = random.Random(12)
    texts = [None, "", " ", "  x Y\x0b\x0cz \n", *("".join(r.choice([*"aBÉé. \t\n\r\x1c\x1f\x85\u00a0"]) for _ in range(r.randrange(12))) for _ in range(500))]
    for column in (pa.array(texts), pa.array(texts).slice(7, 300), pa.array(texts, pa.large_string()).slice(4)):
        words, places, counts = distinct_words(column)
        own = np.split(words.cast(pa.binary()).to_numpy(zero_copy_only=False)[places], np.cumsum(counts)[:-1])
        assert [x.tolist() for x in own] == [words_of(t and t.encode()) for t in column.to_pylist()]


def test_language_model_slopes():
    """The slopes that training follows are those of the loss, and a row's chances add up to one."""
    r = np.random.default_rng(3)
    network = gated_lm.GatedNetwork.fresh(np.ones(gated_lm.CLASSES + gated_lm.SHAPES), np.ones(gated_lm.VOCABULARY))
    network.p = {k: v.astype(np.float32) for k, v in network.p.items()}
    block, last = r.integers(0, 300, (4, 3)), r.integers(0, 300, (1, 3))
    block[1, 1] = gated_lm.VOCABULARY + 5
    given, state = np.vstack([last, block[:-1]]), np.zeros((gated_lm.HIDDEN, 3), np.float32)

    def loss() -> float:
        h, _ = network.steps(given, state)
        return -float(network.log_chances(h.reshape(-1, gated_lm.HIDDEN), block.ravel())[0].sum(dtype=np.float64))

    grads, keep = {k: np.zeros_like(v) for k, v in network.p.items()}, []
    h, _ = network.steps(given, state, keep)
    back = network.log_chances(h.reshape(-1, gated_lm.HIDDEN), block.ravel(), grads)[1]
    network._backward(given, keep, np.ascontiguousarray(back.reshape(h.shape).swapaxes(1, 2)), grads)
    for name, slope in grads.items():
        way = np.sign(slope)
        network.p[name] += np.float32(1e-2) * way / max(1.0, np.sqrt(np.abs(way).sum()))
        up = loss()
        network.p[name] -= np.float32(2e-2) * way / max(1.0, np.sqrt(np.abs(way).sum()))
        down = loss()
        network.p[name] += np.float32(1e-2) * way / max(1.0, np.sqrt(np.abs(way).sum()))
        assert (up - down) / 2e-2 == pytest.approx(np.abs(slope).sum() / max(1.0, np.sqrt(np.abs(way).sum())), rel=2e-2)
    every = np.array([*range(gated_lm.VOCABULARY + gated_lm.SHAPES)])
    chances = network.log_chances(np.repeat(h.reshape(-1, gated_lm.HIDDEN)[:1], len(every), 0), every)[0]
    assert np.exp(chances.astype(np.float64)).sum() == pytest.approx(1, rel=1e-4)


def test_language_model_base(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(["Alpha", "alpha", "beta", "gamma.", "é"]) + str(r.randrange(3)) for _ in range(r.randrange(30))) for _ in range(120)] + [None, "", "\x0b \t", "never seen before", "w " * 3000]
    held = lambda k: k % 7 == 2
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for t in texts]
    counts = Counter(w for k, own in enumerate(tokens) if not held(k) for w in own)
    total, kinds = sum(counts.values()), len(counts)
    df = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "doc_id bigint, text string, score double")
    rows = {x["doc_id"]: x for x in gated_lm.score_texts(df, F.col("doc_id") % 7 != 2).collect()}
    assert len(rows) == len(texts)
    for k, own in enumerate(tokens):
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own)
        assert (rows[k]["n_tokens"], rows[k]["n_known"], rows[k]["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert rows[k]["base_score"] == pytest.approx(base, rel=1e-9)
        assert math.isfinite(rows[k]["score"]) and rows[k]["score"] < 0


def _template(text):
    """Words of the template, with kind and filler of each placeholder."""
    out, ended = [], True
    for token in text.split():
        core = token.strip(".,?!:;\"'()")
        if decontamination._NUMBER.fullmatch(core):
            out.append(("number", core.lower()))
        elif core.lower() in decontamination.UNITS:
            out.append(("unit", core.lower()))
        elif len(core) > 1 and core[0].isupper() and core[1:].islower() and not ended:
            out.append(("name", core.lower()))
        elif core:
            out.append((None, core.lower()))
        ended = token.rstrip("\"')")[-1:] in tuple(".!?:")
    return out


def _leaks(docs, items):
    found = set()
    for doc, text in docs:
        theirs = _template(text or "")
        for item, item_text in items:
            own = _template(item_text or "")
            size = min(8, len(own))
            blank = lambda part: [k or ("word", w) for k, w in part]
            starts = [p for p in range(len(own) - size + 1) if sum(k is None for k, _ in own[p:p + size]) >= min(4, (size + 1) // 2)] if size else []
            sound = set()
            by_shift = defaultdict(list)
            for p in starts:
                for q in range(len(theirs) - size + 1):
                    if blank(own[p:p + size]) == blank(theirs[q:q + size]):
                        by_shift[q - p].append((p, q))
            for met in by_shift.values():
                stands = defaultdict(set)
                for p, q in met:
                    for a, b in zip(own[p:p + size], theirs[q:q + size]):
                        if a[0]:
                            stands[a].add(b)
                sound |= {p for p, q in met if all(not a[0] or len(stands[a]) == 1 for a in own[p:p + size])}
            if starts and len(sound) >= 0.5 * len(starts):
                found.add((doc, item))
    return found


def test_leaks(spark):
    r = random.Random(10)
    words = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    fill = {"N": lambda: str(r.randrange(1, 60)), "P": lambda: r.choice(["Leeds", "Anna", "Boris", "York", "Clara"]), "U": lambda: r.choice(["km", "kg", "hours", "miles"])}
    shapes = [[r.choice([*words * 2, "N", "N1", "P", "U"]) for _ in range(r.choice([3, 6, 9, 14, 24]))] for _ in range(25)]

    def filled(shape, consistent):
        fixed = {}
        return " ".join(("" if w in words else "") + (w if w in words else (fixed.setdefault(w, fill[w[0]]()) if consistent else fill[w[0]]())) for w in shape)

    items = [(k, filled(s, True)) for k, s in enumerate(shapes)] + [(90, None), (91, ""), (92, "7 8 9")]
    docs = []
    for k in range(220):
        noise = lambda: " ".join(r.choice(words) + r.choice(["", "", ".", ","]) for _ in range(r.randrange(12)))
        docs.append((k, " ".join([noise(), *([filled(r.choice(shapes), r.random() < 0.6)] if r.random() < 0.7 else []), noise()])))
    docs += [(300, None), (301, "")]
    want = _leaks(docs, items)
    assert 20 < len(want) < 220
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want


def test_shards_keep_copies_together(spark):
    texts = [f"text {k}" for k in range(100) for _ in range(5)] + [f"lone {k}" for k in range(107)]
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "doc_id bigint, text string, size int").repartition(5)
    rows = sharding.shard_documents(df, shards=3).collect()
    counts = Counter(x["shard"] for x in rows)
    assert sorted(counts.values()) == [202, 202, 203]
    assert all(sorted(x["slot"] for x in rows if x["shard"] == s) == list(range(n)) for s, n in counts.items())
    places = defaultdict(set)
    for x in rows:
        assert (x["size"], x["text_crc32"]) == (len(texts[x["doc_id"]]) + 1, zlib.crc32(texts[x["doc_id"]].encode()))
        places[texts[x["doc_id"]]].add(x["shard"])
    assert sum(len(own) > 1 for own in places.values()) <= 2  # the two cuts between three shards


def test_rounds_lower_the_cut_of_shards(spark, monkeypatch):
    r = random.Random(9)
    groups = [r.choice([2, 3, 4, 7]) for _ in range(60)] + [90]  # the largest fits in no shard
    texts = [f"text {k}" for k, n in enumerate(groups) for _ in range(n)] + [f"lone {k}" for k in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)

    def cut_pairs():
        rows = sharding.shard_documents(df).collect()
        counts = Counter(x["shard"] for x in rows)
        assert max(counts.values()) - min(counts.values()) <= 1 and len(rows) == len(texts)
        assert all(sorted(x["slot"] for x in rows if x["shard"] == s) == list(range(n)) for s, n in counts.items())
        places = defaultdict(Counter)
        for x in rows:
            places[texts[x["doc_id"]]][x["shard"]] += 1
        pairs = lambda n: n * (n - 1) // 2
        return sum(pairs(sum(own.values())) - sum(map(pairs, own.values())) for own in places.values()), sum(len(own) > 1 for t, own in places.items() if t != "text 60")

    settled, cut = cut_pairs()
    monkeypatch.setattr(sharding, "ROUNDS", 0)
    start, cut_at_start = cut_pairs()
    assert cut_at_start > 40 and cut <= 8 and settled < 0.8 * start


def test_shards_reach_the_least_cut(spark):
    sizes = [3, 3, 2, 2]
    texts = [f"text {k}" for k, n in enumerate(sizes) for _ in range(n)] + ["a", "b", "c", "d"]
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), shards=2).collect()
    places = defaultdict(Counter)
    for x in rows:
        places[texts[x["doc_id"]]][x["shard"]] += 1
    cut = sum(own[0] * own[1] for own in places.values())
    least = min(
        sum(k * (n - k) for k, n in zip(split, sizes))
        for split in itertools.product(*[range(n + 1) for n in sizes]) if 3 <= sum(split) <= 7)  # four lone ones fill up either side to seven
    assert least == 0 and cut <= 2


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_grades_on_held_out_rows(spark, label):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = ordinal.fit_labels(docs, labels.where(half), label)
    rows = ordinal.grade_texts(docs.select("doc_id", "text"), model).join(labels.where(~half).select("doc_id", label), "doc_id").where(f"{label} IS NOT NULL")
    scored = [(x["expected_grade"], x[label]) for x in rows.select("expected_grade", label).collect()]
    high, low = [s for s, y in scored if y > 0], [s for s, y in scored if y == 0]
    if not high or not low:
        pytest.skip("one grade only")
    ranks = sum((a > b) + 0.5 * (a == b) for a in high for b in low)
    assert ranks / (len(high) * len(low)) > 0.75


def test_language_model_learns_from_every_token(spark, monkeypatch):
    """Training visits all training texts whole: long ones, more than a few thousand, and those without an id."""
    seen, once = [], gated_lm._train
    monkeypatch.setattr(gated_lm, "_train", lambda pieces, *more: seen.append((pieces, *more[1:])) or once(pieces, *more))
    monkeypatch.setattr(gated_lm, "PART_TOKENS", 900)
    monkeypatch.setattr(gated_lm, "REPEATED", 9000)
    monkeypatch.setattr(gated_lm, "FAN", 4)
    rows_ = [(k if k else None, f"w{k % 50} a b") for k in range(2500)] + [(9000, "x y " * 2500), (9001, None)]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string").repartition(2)
    scores = gated_lm.score_texts(df, F.coalesce("doc_id", F.lit(1)) != 5).collect()
    pieces, parts, repeated = seen[0]
    tokens = pieces.selectExpr("sum(length(tokens)) div 2", "max(length(tokens)) div 2", "count(DISTINCT part)").first()
    assert tokens[0] == scores[0]["train_tokens"] == 4 * 2499 + 5001 + 1 and tokens[1] <= gated_lm.STRETCH
    assert (parts, repeated) == (17, False) and tokens[2] == 17 and len(scores) == 2502
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in scores)


def test_every_round_trains_on_all_parts(spark, monkeypatch, tmp_path):
    """However many training tokens there are, a part is visited in each round, and the parts weigh alike in its average."""
    once, average = gated_lm._train_part, gated_lm._average
    weights = []

    def watched(state, turn):
        inner, folder = once(state, turn), str(tmp_path)

        def run(table):
            with open(f"{folder}/{turn}-{table.column('part')[0].as_py()}", "x") as seen:
                seen.write(str(sum(map(len, table.column("tokens").to_pylist())) // 2))
            return inner(table)

        return run

    def weighed(states, own):
        weights.append(sum(own))
        return average(states, own)

    monkeypatch.setattr(gated_lm, "_train_part", watched)
    monkeypatch.setattr(gated_lm, "_average", weighed)
    monkeypatch.setattr(gated_lm, "PART_TOKENS", 900)
    monkeypatch.setattr(gated_lm, "REPEATED", 1000)
    monkeypatch.setattr(gated_lm, "FAN", 4)
    df = spark.createDataFrame([(k, f"w{k % 50} a b") for k in range(2000)], "doc_id bigint, text string")
    tokens = gated_lm.score_texts(df, F.lit(True)).first()["train_tokens"]
    for turn in range(gated_lm.TURNS):
        seen = list(tmp_path.glob(f"{turn}-*"))
        assert len(seen) == 9 and sum(int(f.read_text()) for f in seen) == tokens == 8000
    assert weights == [9] * gated_lm.TURNS
