"""Each operator against brute force on small fixtures that hold nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronolith.llm import license_scan, line_dedup, mixing, near_dedup, packing, quality_rules, sharding, suffix_dedup, token_files, topk
from chronolith.llm.suffix_array import suffix_array
from chronolith.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, slot string, rank string, h string, key string, version string"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def prose(rng, n, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary):x}{'aeiou'[rng.randrange(5)]}" for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 9]) for i in range(0, n, 9))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([1, 4, 30, 120, 300])) for _ in range(40)]
    near = texts[3].split(" ")
    near[len(near) // 2] = "changed"
    passage = prose(rng, 60)
    texts += [None, "", " \n\n ", "é 世界 \U0001f600 ñandú", texts[0], texts[0], " ".join(near), prose(rng, 9000)]
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40) for _ in range(3)]
    texts += ["ab " * 200, "x" * 700, prose(rng, 80) + "\nReleased under the MIT License.", prose(rng, 80) + "\nLicensed under CC BY-NC 4.0.", "MIT licenses; the Kit License. General, public LICENSE and ApacheK License"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(0, texts[0]), (5, "another text under one id " * 9), (None, texts[7]), (None, "without an id " * 20)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, 0, *["clash"] * 6) for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_gives_the_librarys_ids():
    import pyarrow as pa

    rng = random.Random(5)
    alphabet = "ab^ '\n\t\r éÉİßſK.,!12<|endoftext|>́　\xa0’s't\xad\x1c\x85_-²½ª"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None, prose(rng, 5000)]
    for path in (BYTES, WORDS):
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        want = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [b for _, b in Encoder(path).stream(pa.array(texts))] == want


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_cuts_and_sends_little(monkeypatch, path):
    """Whole words are not cut by patterns; what is new goes to the library once, with nothing in between; every letter comes out as the library has it."""
    import pyarrow as pa

    from chronolith.llm import tokens

    letters = [c for c in map(chr, range(33, 0x180)) if not re.match(tokens._ODD_WORDS, c)]
    words = [a + b for a in letters for b in "aé^"]
    texts = [" ".join(words), "\n".join(words), *words, "plain words alone " * 50]
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert Encoder(path).encode(pa.array(texts)) == want

    enc, sent, cut, aside = Encoder(path), [], [], []
    bare, alone, whole = enc.bare_tokenizer, enc._library, {BYTES: "_spaced_pieces", WORDS: "_word_pieces"}[path]

    class Library:
        def encode_batch_fast(self, batch, **how):
            sent.extend(x for text in batch for x in text.split())
            return bare.encode_batch_fast(batch, **how)

    enc.bare_tokenizer = Library()
    monkeypatch.setattr(enc, "_library", lambda batch: aside.extend(batch) or alone(batch))
    real = getattr(tokens, whole)
    monkeypatch.setattr(tokens, whole, lambda chunk: cut.append(chunk) or real(chunk))
    names = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    enc.encode(pa.array([" ".join(["", *names])[1:], "x^y " + " ".join(names)]))
    assert not aside and not [c for c in cut if c.strip().isalpha()]
    assert len(sent) <= len(names) + 6


def blocks_of(text, reach):
    """The sets of words of each line and those after it."""
    lines = [re.findall(license_scan.WORD, line) for line in text.split("\n")]
    return [set(line + sum(lines[i + 1 : i + 1 + license_scan.LINES], [])[:reach]) for i, line in enumerate(lines)]


def test_license_scan_finds_wrapped_notices(spark):
    notice = license_scan.TEMPLATES[1][1]
    words = notice.split()
    texts = [notice, "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7)), "Some words before. " + "\n".join([" ".join(words[:3]), " ".join(words[3:14]), " ".join(words[14:])]), "\n\n\n\n\n\n".join([" ".join(words[:10]), " ".join(words[10:])])]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("mit", 1.0), 1: ("mit", 1.0), 2: ("mit", 1.0), 3: ("", 0.0)}


def test_license_scan(docs, corpus, nothing):
    word = re.compile(license_scan.WORD)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = []
    for doc, text in corpus:
        t = (text or "").translate(lower)
        words, places, base, labels, score = word.findall(t), [], set(), set(), 0.0
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += here
            base |= {label} if here else set()
        for block in blocks_of(t, license_scan.reach()):
            for label, wording in license_scan.TEMPLATES:
                tokens = set(license_scan.template_words(wording))
                share = len(tokens & block) / len(tokens)
                if share >= license_scan.THRESHOLD - 1e-9:
                    labels.add(label)
                    score = max(score, share)
        want.append((doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
    got = [tuple(r) for r in license_scan.scan(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(w[5] for w in want) and any("cc-by-nc" in w[6] for w in want)
    assert license_scan.scan(nothing).collect() == []


def test_license_scan_finds_every_match(spark):
    rng = random.Random(2)
    templates = (("a", "one two three four five six seven"), ("b", "two three eight nine"), ("c", "six"))
    words = "one two three four five six seven eight nine ten eleven".split()
    rows = [(i, "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(3))) for i in range(300)]
    got = {(r["doc_id"], r["place"], r["label"]) for r in license_scan.matches(spark.createDataFrame(rows, "doc_id long, text string"), templates, 0.7).collect()}
    want = {(i, k, label) for i, t in rows for k, block in enumerate(blocks_of(t, 7)) for label, wording in templates if len(set(wording.split()) & block) >= 0.7 * len(wording.split())}
    assert got == want


def statistics_of(text):
    words = re.findall(quality_rules.WORD, text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(quality_rules.WORD, x)]
    punct = regex.findall(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]", text or "")
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(punct), len(set(words)), len(regex.findall(r"\p{Lu}", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(docs, corpus, nothing):
    names = ("n_words", "word_chars", "n_symbols", "n_punct", "n_distinct", "n_upper", "n_dup_lines", "n_repeat_words")
    got = sorted((tuple(r[n] for n in ("doc_id", *names)) for r in quality_rules.judge(docs).collect()), key=repr)
    assert got == sorted(((i, *statistics_of(t)) for i, t in corpus), key=repr)
    for r in quality_rules.judge(docs).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(nothing).collect() == []


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(60, 500), 5000), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(f"{w}###$$" for w in prose(rng, 100, 5000).split()), "en", "s") for i in range(40)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(400)) and not any(kept[1000 + i] for i in range(40))


def test_quality_estimate_is_robust(spark):
    """The estimate of a group with a fifth of gross outliers is that of a plain search for the core of least determinant."""
    rng = np.random.default_rng(1)
    mix = np.array([[1, 0, 0, 0], [0.4, 1, 0, 0], [-0.3, 0.2, 1, 0], [0.1, 0.5, 0.2, 1]]) * [[0.2], [0.5], [0.4], [0.8]]
    clean = rng.normal(size=(2000, 4)) @ mix.T + [1.5, -2, 0.9, 3]
    dirty = rng.normal([3.0, 2.0, 0.2, 0.5], 0.1, (400, 4))
    rows = np.round(np.vstack([clean, dirty]) * quality_rules.UNITS)
    e = quality_rules.estimates(spark.createDataFrame([("g", *map(int, x)) for x in rows], "grp string, x0 long, x1 long, x2 long, x3 long")).first()
    place, factor = np.array([e[f"m{i}"] for i in range(4)]), np.zeros((4, 4))
    for i in range(4):
        factor[i, : i + 1] = [e[f"l{i}{j}"] for j in range(i + 1)]
    x, best = rows / quality_rules.UNITS, None
    for _ in range(20):  # random starts of five rows
        d = np.inf
        core = rng.choice(len(x), 5, replace=False)
        while True:
            m, c = x[core].mean(0), np.cov(x[core].T, bias=True) + quality_rules.RIDGE * np.eye(4)
            was, d = d, np.linalg.slogdet(c)[1]
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            core = np.argsort(d2)[: int(0.75 * len(x))]
            if len(core) == int(0.75 * len(x)) and abs(was - d) < 1e-9:
                break
        if best is None or d < best[0]:
            best = d, m, c, d2
    _, m, c, d2 = best
    c = c * np.median(d2) / quality_rules.MEDIAN_CHI
    assert np.allclose(place, clean.mean(0), atol=0.05) and np.allclose(place, m, atol=0.02) and np.allclose(factor @ factor.T, c, rtol=0.06, atol=0.002)
    d2 = ((np.linalg.inv(factor) @ (x - place).T) ** 2).sum(0)
    assert np.median(d2) == pytest.approx(quality_rules.MEDIAN_CHI, rel=0.03) and (d2[2000:] > quality_rules.CUT).all() and (d2[:2000] > quality_rules.CUT).mean() < 0.001


def test_quality_rejects_what_no_single_statistic_shows(spark):
    """Two statistics go together in a group; a document whose values are each usual, but not together, is rejected."""
    rng = random.Random(5)

    def text(commas, capitals):
        words = [w + ("," if rng.random() < commas else "") for w in prose(rng, 1500, 5000).split()]
        return " ".join(w.capitalize() if rng.random() < capitals else w for w in words)

    rows = [(i, text(0.15 + 0.015 * k, 0.15 + 0.015 * k), "en", "s") for i in range(300) for k in [i % 20]] + [(900, text(0.18, 0.42), "en", "s"), (901, text(0.42, 0.18), "en", "s")]
    judged = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, r in judged.items() if not r["kept"]} == {900, 901}
    for name in ("n_punct", "n_upper"):
        usual = [judged[i][name] for i in range(300)]
        assert all(min(usual) <= judged[i][name] <= max(usual) for i in (900, 901))


def test_quality_judges_small_groups(spark):
    """Groups of a few tens and of a few have their outliers rejected and the rest kept, with or without a large group beside them."""
    rng = random.Random(12)
    junk = lambda: " ".join(f"{w}###$$" for w in prose(rng, 100, 5000).split())
    rows = [(i, prose(rng, rng.randint(60, 300), 5000), "de", f"s{i % 3}") for i in range(120)] + [(200 + i, junk(), "de", f"s{i}") for i in range(3)]
    rows += [(300 + i, prose(rng, rng.randint(60, 300), 5000), "de", "few") for i in range(3)] + [(310, junk(), "de", "few"), (311, junk(), "de", "one")]
    more = rows + [(1000 + i, " ".join(w * 3 for w in prose(rng, 120, 5000).split()), "en", "hot") for i in range(300)]
    for table in (rows, more):
        judged = quality_rules.judge(spark.createDataFrame(table, "doc_id long, text string, lang string, source string")).collect()
        assert all(r["d2"] is not None for r in judged if not r["base_failed"])
        assert {r["doc_id"] for r in judged if not r["kept"]} == {200, 201, 202, 310, 311}


def test_packing(docs, corpus, nothing):
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    want = collections.Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in corpus)
    rows = packing.pack(docs, BYTES).collect()
    sequences = collections.defaultdict(list)
    total = 0
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
        total += r["length"]
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == pieces[0]["sequence_length"] <= 1024
    assert total == sum(len(ids) * n for (_, ids), n in want.items())
    have = collections.Counter((r["doc_id"], r["start"], r["ids"]) for r in rows)
    for (i, ids), n in want.items():
        blob = np.array(ids, dtype="<u4").tobytes()
        cuts = sorted({r["start"] for r in rows if r["doc_id"] == i and r["doc_tokens"] == len(ids)} | {len(ids)})
        assert cuts[0] == 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            assert have[i, a, blob[4 * a : 4 * b]] >= n
    assert packing.pack(nothing, BYTES).collect() == []


def test_differencing_respects_the_capacity():
    rng = random.Random(0)
    for _ in range(200):
        sizes = [rng.randint(1, rng.choice([30, 512, 1024])) for _ in range(rng.randint(0, 80))]
        found = packing.partition(sizes, 1024)
        assert sorted(i for p in found for i in p) == list(range(len(sizes))) and all(0 < sum(sizes[i] for i in p) <= 1024 for p in found)
    sizes = [rng.randint(1, 512) for _ in range(1024)]
    assert len(packing.partition(sizes, 1024)) <= 1.02 * sum(sizes) / 1024 + 1


def test_sharding(docs, corpus, nothing):
    rows = sharding.shard(docs, 4, slots=64).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in corpus), key=repr)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(x["slot"] for x in part) == list(range(len(part))) for part in by.values())
    assert sharding.shard(nothing, 4).collect() == []


def test_slot_map_balances_and_grows(spark, tmp_path):
    rng = random.Random(1)
    weights = [int(rng.paretovariate(1.5) * 100) for _ in range(2000)]
    loads = lambda m: [sum(w for w, s in zip(weights, m.of_slot, strict=True) if s == k) for k in range(m.shards)]
    first = sharding.SlotMap.first(40, 2000)
    second = first.rebalanced(weights)
    assert max(loads(second)) - min(loads(second)) < 0.001 * sum(weights) and second.version == 2
    third = second.rebalanced(weights, shards=41)
    moved = [(a, b) for a, b in zip(second.of_slot, third.of_slot, strict=True) if a != b]
    assert max(loads(third)) < 1.02 * sum(weights) / 41 and len(moved) < 400
    for m in (first, second, third):
        m.save(spark, str(tmp_path / "maps"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "maps")) == third and sharding.SlotMap.load(spark, str(tmp_path / "maps"), 2) == second


def test_line_dedup(docs, corpus, nothing):
    """Texts without sentence ends, whose units are lines, against a plain search: runs of repeated lines, with short ones between, of 20 words or more."""
    got = collections.Counter((r["doc_id"], r["n_lines"], r["text"], r["n_removed"], r["n_removed_chars"], tuple((x["start"], x["length"]) for x in r["removed"])) for r in line_dedup.dedup(docs).collect())
    seen, want, times = set(), collections.Counter(), collections.Counter((i, t or "") for i, t in corpus)
    for i, t in sorted(times, key=lambda x: (x[0] is None, x[0] or 0, spark_order(x[1]))):
        if re.search(r"[.!?…]", t):  # these have sentences, and share none
            continue
        lines, again = t.split("\n"), []
        for line in lines:
            norm = re.sub(r"[\W_]+", " ", line.lower()).strip()
            long = len(norm.split(" ")) >= 5
            again.append(long and norm in seen)
            seen |= {norm} if long else set()
        gone, run = set(), []
        for k in [*range(len(lines)), None]:
            if k is not None and (again[k] or run and len(lines[k].split()) < 5):
                run.append(k)
                continue
            while run and not again[run[-1]]:
                run.pop()
            if sum(len(lines[x].split()) for x in run) >= 20:
                gone |= set(run)
            run = []
        at = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
        spans = tuple((at[k], len(lines[k])) for k in sorted(gone))
        want[i, len(lines), "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone), sum(n for _, n in spans), spans] += times[i, t]
    assert sum(w[3] for w in want) > 20 and not want - got and line_dedup.dedup(nothing).collect() == []


def test_line_dedup_finds_passages_within_lines(spark):
    """A passage set in the middle of other lines, broken elsewhere, and in one line: all but the sentence it begins within and a short one after that go."""
    rng = random.Random(17)
    sentence = lambda n: " ".join(f"w{rng.randrange(99999)}" for _ in range(n)).capitalize() + "."
    inside = [sentence(12), sentence(3), sentence(9), sentence(20), sentence(14)]
    own = [[sentence(rng.randint(6, 15)) for _ in range(6)] for _ in range(4)]
    line, broken = " ".join(inside), " ".join(inside).replace(" ", "\n", 7).replace(" ", "\n", 1)
    texts = [" ".join(own[0][:3]) + " " + line + " " + " ".join(own[0][3:]), " ".join(own[1][:3]) + " cut " + line + " " + " ".join(own[1][3:]), own[2][0] + " " + broken + " " + own[2][1], " ".join(own[3])]
    got = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["text"] == texts[0] and got[3]["text"] == texts[3] and got[0]["n_removed"] == got[3]["n_removed"] == 0
    assert not any(s in got[1]["text"] for s in inside[2:]) and all(s in got[1]["text"] for s in own[1])
    assert got[2]["text"].split() == " ".join(own[2][:2]).split()
    for i in (1, 2):
        gone = got[i]["removed"]
        assert sum(s["length"] for s in gone) == got[i]["n_removed_chars"] and all(a["start"] + a["length"] <= b["start"] for a, b in zip(gone, gone[1:], strict=False))


def spark_order(text):
    """Ties of doc_id go by xxhash64 of the text, as Spark has it."""
    import xxhash

    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_short_lines_between_removed_ones_go():
    kept, n, removed, chars, spans = line_dedup.removal("a\nlong line one\nb\nlong line two\nc\nnew line here", [{"place": 1, "first_doc": 9}, {"place": 3, "first_doc": 9}], 3)
    assert kept == "a\nc\nnew line here" and [s["start"] for s in spans] == [2, 16, 18]


def test_mixing(docs, corpus, nothing):
    rows = mixing.plan(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # as stated: share, cut off at three times the size, share the excess again
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(w for x, w in weight.items() if x not in capped) for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    largest = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(0 <= target[s] - taken[s] <= largest[s] + 1 for s in order)
    assert sorted(map(repr, mixing.plan(docs).drop("row").collect())) == sorted(map(repr, rows))
    assert mixing.plan(nothing).collect() == []


def test_mixing_caps_small_sources(spark):
    rows = [(i, "w " * 10, "big") for i in range(90)] + [(100 + i, "w " * 10, "tiny") for i in range(2)] + [(200 + i, "w " * 10, None) for i in range(8)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert {r["source"]: (r["t"], r["k"]) for r in got} == {"big": (700.0, 700), "tiny": (60.0, 60), None: (240.0, 240)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_against_edit_distance():
    rng = random.Random(7)
    for _ in range(800):
        v = rng.choice([3, 30, 500])
        a = [rng.randrange(v) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(b) + 1)
            op = rng.random()
            if op < 0.4 and b:
                b[at % len(b)] = rng.randrange(v)
            elif op < 0.7:
                b.insert(at, rng.randrange(v))
            elif len(b) > 1:
                b.pop(at % len(b))
        want = edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
        assert near_dedup.similar(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)) == want


def test_near_dedup(spark, docs, corpus, nothing):
    rng = random.Random(3)
    groups, rows, linked = [], [], 0
    for _ in range(30):
        words = [f"t{rng.randrange(9999)}" for _ in range(rng.choice([12, 60, 250]))]
        ids = []
        for copy in range(rng.choice([1, 2, 6])):
            w = list(words)
            for _ in range(copy and max(1, len(w) // 25)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
            ids.append(len(rows))
            rows.append((len(rows), " ".join(w).title() if copy % 2 else " ".join(w)))
        groups.append(ids)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = [{tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    for ids in groups:
        assert {got[i] for i in ids} <= set(ids)
        for i in ids:
            for j in ids:
                linked += i < j and got[i] == got[j]
                if len(shingles[i] & shingles[j]) >= 0.6 * len(shingles[i] | shingles[j]):
                    assert got[i] == got[j]
    assert linked > 100
    result = near_dedup.classes(docs).collect()
    assert len(result) == len(corpus)
    empty = {r["class_id"] for r in result if r["doc_id"] in (40, 41, 42)}
    assert empty == {40} and {r["class_id"] for r in result if r["doc_id"] in (44, 45)} == {0}
    texts = dict((t, i) for i, t in corpus if i is not None)
    assert {r["class_id"] for r in result if r["doc_id"] is None} == {7, None} and not any(r["first"] for r in result if r["doc_id"] is None and r["class_id"] == 7)
    assert sum(r["first"] for r in result if r["class_id"] is None) == 1 and texts[corpus[7][1]] == 7
    assert near_dedup.classes(nothing).collect() == []


@pytest.mark.parametrize("nodes", [1000, 7])
def test_near_dedup_compares_all_of_a_bucket(spark, monkeypatch, nodes):
    """Hubs with copies that are no links of each other, and unrelated texts that share a passage, against all pairs of each bucket."""
    monkeypatch.setattr(near_dedup, "TILE_NODES", nodes)
    rng = random.Random(31)
    texts = []
    for _ in range(12):
        hub = [f"h{rng.randrange(99999)}" for _ in range(60)]
        texts.append(hub)
        for _ in range(9):
            copy = list(hub)
            for k in rng.sample(range(60), 11):
                copy[k] = f"c{rng.randrange(99999)}"
            texts.append(copy)
    passage = [f"p{k}" for k in range(40)]
    for _ in range(15):
        one = passage + [f"q{rng.randrange(99999)}" for _ in range(20)]
        texts += [one, [*one[:50], *(f"z{rng.randrange(99999)}" for _ in range(9))]]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    hashes = near_dedup.WordHashes()
    words = [hashes(t) for _, t in rows]
    keys = [set(enumerate(s.tolist())) for s in near_dedup.sketches(words)]
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if want[i] != want[j] and keys[i] & keys[j] and near_dedup.similar(words[i], words[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_near_dedup_aligns_few_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, 700, dtype=np.uint32)

    def copy(changed):
        out = base.copy()
        out[rng.choice(700, changed, replace=False)] = rng.integers(0, 1 << 32, changed, dtype=np.uint32)
        return out

    # Of two copies with 95 words changed each, about 177 of 700 words differ, and 140 may.
    words = [copy(95) for _ in range(60)] + [copy(20) for _ in range(20)]
    calls, similar = [], near_dedup.similar
    monkeypatch.setattr(near_dedup, "similar", lambda *a: calls.append(a) or similar(*a))
    one = np.zeros(80, dtype=np.int64)
    assert near_dedup.joining(words[:60], np.arange(60), one[:60]) == [] and not calls
    links = near_dedup.joining(words, np.arange(80), one)
    assert len(links) == 79 and len(calls) < 200
    assert near_dedup.joining(words, np.arange(80), one, elsewhere=[frozenset([7])] * 80) == []
    monkeypatch.setattr(near_dedup, "SLICE_WORDS", 5000)
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    assert near_dedup.joining(words, np.arange(80), one) == links


def test_near_dedup_distances():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (rng.integers(0, rng.integers(2, 6), rng.integers(0, 40)).astype(np.uint32) for _ in "ab")
        row = list(range(len(b) + 1))
        for i, x in enumerate(a.tolist(), 1):
            before, row = row, [i]
            for j, y in enumerate(b.tolist(), 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        for band in (0, 5, 20, 40):
            got = near_dedup._bitwise(a, b, band)
            assert got == row[-1] if row[-1] <= band else got > band


def test_near_dedup_recall(spark):
    """Of all pairs within the edit similarity, by brute force, at least 0.98 share a class; classes are no larger than links make them."""
    rng = random.Random(41)
    texts = []
    for _ in range(25):
        base = [f"b{rng.randrange(99999)}" for _ in range(rng.randint(8, 90))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 5)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(3)] = [f"x{rng.randrange(99999)}" for _ in range(rng.randrange(3))]
            texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    label, pairs = list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            if i // 6 == j // 6 and edits(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j])):
                pairs.append((i, j))
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert len(pairs) > 100 and sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)
    assert all(label[i] == label[got[i]] for i in got)


def test_topk(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(50)]
    rows += [(360, None), (380, [1.0, None] + [0.0] * 6), (400, [float("nan")] * 8), (420, [float("inf")] + [0.0] * 7), (440, [0.25] * 3), (441, [0.5] * 3), (5, rows[5][1]), (None, [0.1] * 8), (460, [1e9] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    for cells in ((None, None), (7, 40)):
        got = collections.defaultdict(list)
        for r in topk.exact_topk(frame, F.col("vec_id") % 20 == 0, 20, cell_queries=cells[0], cell_rows=cells[1]).collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
        for i, v in ok:
            if i % 20 == 0:
                scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i and len(w) == len(v)))[:20]
                assert sorted(got.pop(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(scored)]
        assert not got
    assert topk.exact_topk(frame.limit(0), F.col("vec_id") % 20 == 0, 20).collect() == []


def test_topk_of_very_large_components(spark):
    """Scores beyond 64 bits count as the nearest number of 64 bits."""
    rows = [(20, [1e30, -1e30]), (1, [1e30, 0.0]), (2, [0.0, 1e30]), (3, [2e30, 0.0]), (4, [1e12, 3.0]), (5, [0.5, 0.25]), (40, [1e9, 1.0]), (6, [3e8, -7.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, row_id string, score long")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_topk(frame, F.col("vec_id") % 20 == 0, 20).collect()}
    most = (1 << 63) - 1
    for i, v in rows:
        if i % 20 == 0:
            dot = {j: max(-most, min(most, sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w, strict=True)))) for j, w in rows if j != i}
            assert [got[i, k + 1] for k in range(7)] == sorted(dot.items(), key=lambda x: (-x[1], x[0]))


def test_mixing_buckets_are_even_for_any_quality(spark):
    """Texts of very long words, whose keys are large, do not fall in one bucket."""
    from chronolith.llm import mixing as m

    keyed = spark.range(40_000).select(F.col("id").alias("doc_id")).select((-F.log(m.uniform(17)) * F.element_at(F.array(F.lit(1.0), F.lit(200.0)), (F.col("doc_id") % 2 + 1).cast("int"))).alias("key"))
    bucket = F.floor((F.log2("key") + 40) * m.BUCKETS)
    assert keyed.groupBy(bucket).count().agg(F.max("count")).first()[0] < 40


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def covered(texts, length):
    """Removed bytes of texts in order, by looking at every string."""
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out.append(gone)
    return out


@pytest.mark.parametrize("limit", [1000, 2])
def test_suffix_dedup(docs, corpus, nothing, limit):
    texts = sorted({(i, t or "") for i, t in corpus}, key=lambda x: (x[0] is None, x[0] or 0, spark_order(x[1])))
    want = collections.Counter()
    times = collections.Counter((i, t or "") for i, t in corpus)
    for (i, t), gone in zip(texts, covered([t.encode() for _, t in texts], 100), strict=True):
        rest = bytes(b for b, g in zip(t.encode(), gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        want[i, len(gone), len(gone) - len(rest), spans, rest] += times[i, t]
    rows = suffix_dedup.dedup(docs, limit=limit).collect()
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows)
    assert got == want and sum(w[2] for w in want) > 1000
    assert suffix_dedup.dedup(nothing).collect() == []


def test_suffix_dedup_small_alphabets(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab") * rng.randint(1, 5) for _ in range(rng.randint(0, 120)))) for i in range(40)]
    rows += [(50 + i, (rows[i][1] + rows[i + 1][1])[rng.randrange(20) :]) for i in range(20)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=30, gram=8).collect()}
    for (i, t), gone in zip(rows, covered([t.encode() for _, t in rows], 30), strict=True):
        assert got[i] == bytes(b for b, g in zip(t.encode(), gone, strict=True) if not g)


def test_anchors_across_pieces(monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, n).encode() for n in (3, 900, 0, 40, 2000)]
    found = lambda: {x for block in suffix_dedup.text_anchors(texts) for x in zip(*(column.tolist() for column in block), strict=True)}
    whole = found()
    assert len({c for *_, c, _ in whole}) > 0.9 * len(whole) > 100
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    assert found() == whole


def test_suffix_dedup_of_many_without_an_id(spark):
    """Texts that share a rank are told apart by 64 bits, and each loses its own strings alone."""
    rng = random.Random(13)
    passage = prose(rng, 60)
    texts = sorted({prose(rng, rng.randint(5, 40)) + (passage if i % 5 == 0 else "") + prose(rng, 5) for i in range(600)}, key=spark_order)
    frame = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    got = collections.Counter(bytes(r["kept"]) for r in suffix_dedup.dedup(frame).collect())
    assert got == collections.Counter(bytes(b for b, g in zip(t.encode(), gone, strict=True) if not g) for t, gone in zip(texts, covered([t.encode() for t in texts], 100), strict=True))


def test_suffix_array_finds_what_contexts_share():
    """Removed strings of distinct contexts of one anchor, against all pairs of their strings."""
    rng = random.Random(19)
    for _ in range(60):
        sides = [("".join(rng.choice("ab") * rng.randint(1, 9) for _ in range(12))[-16:], "anchor" + "".join(rng.choice("ab") * rng.randint(1, 9) for _ in range(12))[:24]) for _ in range(rng.randint(2, 9))]
        group = [((k, 0), 100 * k + 50, left.encode(), right.encode()) for k, (left, right) in enumerate(dict.fromkeys(sides))]
        seen, want = set(), set()
        for key, place, left, right in group:
            text = left + right
            for at in range(len(text) - 19):
                if text[at : at + 20] in seen:
                    want |= {(key, place - len(left) + at + k) for k in range(20)}
            seen |= {text[at : at + 20] for at in range(len(text) - 19) if at <= len(left) and at + 20 >= len(left) + 6}
        want = {x for x in want}
        got = {(key, k) for key, a, b in suffix_dedup.later(group, 20) for k in range(a, b)}
        holds = {(key, place - len(left) + at + k) for key, place, left, right in group for at in range(len(left + right) - 19) if at <= len(left) and at + 20 >= len(left) + 6 for k in range(20)}
        assert want & holds <= got


def test_token_files(spark, docs, corpus, nothing, tmp_path):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    path = str(tmp_path / "files")
    rows = token_files.round_trip(docs, WORDS, 1, path).collect()
    ordered = sorted(corpus, key=lambda x: (x[0] is not None, x[0] or 0))
    have = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows))
    at = 0
    for start, _, n, _ in have:
        assert start == at
        at += n
    assert [d for _, d, *_ in have] == [d for d, _ in ordered]
    want = collections.Counter((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())) for i, t in corpus)
    assert collections.Counter((d, c) for _, d, _, c in have) == want
    plan = token_files.read(spark, path, ("doc_id", "n_tokens"))._jdf.queryExecution().toString()
    assert not re.search(r"ReadSchema: \S*ids", plan)
    assert token_files.round_trip(nothing, WORDS, 1).collect() == []


def test_token_files_have_pages_and_indexes(spark, tmp_path):
    """What the footers say of encodings and indexes, and that a range of documents reads few row groups."""
    import pyarrow.parquet as pq

    rng, path = random.Random(3), str(tmp_path / "files")
    frame = spark.createDataFrame([(i, prose(rng, 400, 60 if i < 1500 else 90_000)) for i in range(3000)], "doc_id long, text string").repartition(2)
    token_files.write(frame, path, WORDS, 1, row_group=256 << 10, page=16 << 10)
    kinds, groups = set(), 0
    for part in sorted((tmp_path / "files").glob("part-*")):
        meta = pq.ParquetFile(part).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = [meta.row_group(g).column(c) for c in range(meta.num_columns)]
            assert all(c.has_offset_index and c.has_column_index for c in columns)
            kinds |= {e for c in columns if c.path_in_schema.startswith("ids") for e in c.encodings}
    assert groups > 4 and kinds & {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} and "PLAIN_DICTIONARY" not in kinds
    few = token_files.read(spark, path, ("doc_id", "ids")).where("doc_id between 700 and 703")
    assert sorted(r["doc_id"] for r in few.collect()) == [700, 701, 702, 703]
    assert "GreaterThanOrEqual(doc_id,700)" in few._jdf.queryExecution().toString()


def test_sha_of_everything_kept(docs):
    row = suffix_dedup.dedup(docs.where("doc_id = 41")).first()
    assert hashlib.sha256(bytes(row["kept"])).hexdigest() == hashlib.sha256(b"").hexdigest()
