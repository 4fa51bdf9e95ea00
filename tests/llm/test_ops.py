"""The training-data operators against brute force on a small table with nulls, ties, copies and odd texts."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import chat, langid, minhash, mixing, quality, sentencepiece_scan, sharding, simhash, suffix_dedup, topk

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORDS = ["the", "and", "der", "und", "le", "pour", "Stone", "river,", "ünter", "naïve.", "漢字"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [sentence(rng, n) for n in (1, 3, 5, 40, 200, 900)]
    shared = sentence(rng, 60)
    texts = [*base, base[4], base[4], base[4] + " one more", shared + " a b c", "x y " + shared, base[5][:3000] + shared, "", " \t\n", None, "ab " * 400, "\\### <turn> ok", "Ünïcode " * 30, "word " * 3000]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "no id here"), (None, None), (5, "a second text of the same id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", k, "s", 1.5) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, n_chars int, source string, score double").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


# ------------------------------------------------------------------ op1, op10


def test_language(spark, nothing):
    rng = random.Random(1)
    kinds = {"aa": ["bado", "bedi", "bolu", "dabe"], "zz": ["kirt", "krst", "trik", "skur"]}
    data = [(i, " ".join(rng.choice(kinds[k]) for _ in range(80)), k) for i in range(60) for k in kinds]
    train = spark.createDataFrame([(i, t, k) for i, t, k in data if i < 40], "doc_id long, text string, lang string")
    model = langid.fit_languages(train)
    test = spark.createDataFrame([*[(i, t, k) for i, t, k in data if i >= 40], (-1, None, "aa"), (-2, " 12 !", "aa"), (None, "bado " * 5000, "aa")], "doc_id long, text string, lang string")
    got = langid.identify(test, model, ["doc_id", "lang"]).collect()
    assert all(r["lang_pred"] == ("und" if r["doc_id"] in (-1, -2) else r["lang"]) and 0 <= r["score"] <= 1 for r in got) and len(got) == test.count()
    assert langid.identify(nothing, model, ["doc_id"]).count() == 0
    assert langid.fit_languages(nothing) is None
    assert {r["lang_pred"] for r in langid.identify(test, None, ["doc_id"]).collect()} == {"und"}


def test_phrases_are_longest_matches(spark):
    ref = "abracadabra abacus"
    train = spark.createDataFrame([(1, ref, "x")], "doc_id long, text string, lang string")
    model = langid.fit_languages(train)
    symbols, _ = langid.to_symbols([f" {ref} "], model.symbols)
    held = bytes(symbols)
    for text in ("abra", "cabracad", "zzz", "a", "abacus abba dabra", "q" * 700, "abrazabra", "zabra cz", "zq abra"):
        s, _ = langid.to_symbols([text], model.symbols)
        s, n = bytes(s), 0
        for run in (s[i : i + langid.RUN] for i in range(0, len(s), langid.RUN)):
            at, n = 0, n + 1  # the last phrase; every other one is counted where it ends
            while at < len(run):
                size = 0
                while at + size < len(run) and run[at : at + size + 1] in held:
                    size += 1
                at += size
                if at < len(run):  # a phrase ends here; a symbol that occurs nowhere ends with it
                    n += 1
                    at += run[at : at + 1] not in held
        assert langid.phrase_counts([text], model)[0][0, 0] == n, text


def test_scripts_stay_apart(spark):
    """Letters beyond the commonest ones are told apart by their block of code points."""
    rng = random.Random(6)
    spell = lambda first: " ".join("".join(chr(first + rng.randrange(200)) for _ in range(4)) for _ in range(60))
    first = {"han": 0x4E00, "hangul": 0xAC00, "yi": 0xA000}
    data = [(10 * i + k, spell(c), lang) for i in range(40) for k, (lang, c) in enumerate(first.items())]
    model = langid.fit_languages(spark.createDataFrame(data[:60], "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame(data[60:], "doc_id long, text string, lang string"), model, ["lang"]).collect()
    assert len(got) == 60 and all(r["lang"] == r["lang_pred"] for r in got)
    small = langid.fit_languages(spark.createDataFrame(data[:60], "doc_id long, text string, lang string"), total=300)
    assert all(len(t) <= 2 * 100 * langid.ALPHABET for t in small.tables)


def test_quality(spark, docs, nothing):
    rng = random.Random(2)
    good = [(i, sentence(rng, 120), 1) for i in range(60)]
    bad = [(100 + i, "!!! ".join(w.upper() for w in sentence(rng, 120).split()), 0) for i in range(60)]
    train = spark.createDataFrame([*good, *bad, (7000, None, 0), (None, "x", 1)], "doc_id long, text string, quality int")
    labels = train.select("doc_id", "quality").union(spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    model = quality.fit_quality(train, labels)
    got = train.where("doc_id < 7000").withColumn("s", quality.quality_score("text", model)).collect()
    assert np.mean([(r["s"] >= 0.5) == r["quality"] for r in got]) > 0.95
    scored = docs.select("doc_id", "text", quality.quality_score("text", model).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in scored) and len({r["s"] for r in scored if not r["text"]}) == 1
    assert quality.fit_quality(nothing, labels) is None
    assert docs.select(quality.quality_score("text", None).alias("s")).first()["s"] == 0.5


def test_quality_score_by_hand(spark):
    """A score recomputed with the compressor alone, on repeated ids, ties, long and empty texts."""
    import zstandard

    rng = random.Random(12)
    data = [(i, sentence(rng, 60), i % 2) for i in range(40)] + [(3, "another text of id three", 1), (3, "another text of id three", 0)]
    train = spark.createDataFrame(data, "doc_id long, text string, quality int")
    model = quality.fit_quality(train, train)
    assert model == quality.fit_quality(train.repartition(5), train.repartition(2))  # whatever the order of the rows
    texts = ["", None, "the and", sentence(rng, 30), sentence(rng, 20_000), "Ünïcode" * 99, data[0][1], data[0][1]]
    got = [r["s"] for r in spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1).select(quality.quality_score("t", model).alias("s")).collect()]

    def size(block, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(block))

    for text, s in zip(texts, got, strict=True):
        raw = (text or "").encode()
        blocks = [raw[i : i + quality.BLOCK] for i in range(0, len(raw), quality.BLOCK)]
        x = sum(size(b, model.bad) - size(b, model.good) for b in blocks)
        x = (x + quality.PRIOR * model.mean) / (len(raw) + quality.PRIOR)
        assert abs(s - 1 / (1 + np.exp(-(model.slope * x + model.intercept)))) < 1e-9
    assert train.where("false").select(quality.quality_score("text", model)).count() == 0
    assert quality.fit_quality(train, train, dictionary=64) is not None


def test_dictionary_leaves_no_piece_out():
    pieces = [b"a" * 50, b"b" * 10, b"c" * 80, b"d" * 5]
    assert quality.dictionary_of(pieces, 1000) == b"\n".join(pieces)
    cut = quality.dictionary_of(pieces, 60)
    assert len(cut) <= 60 and all(cut.count(x[:1]) >= min(len(x), 10) for x in pieces)


# ------------------------------------------------------------------------ op2


def test_templates():
    render = chat.compile_template("{% set a = 1 + 2 %}{{ 'x' ~ 'y' }}{% if false %}no{% elif a == 3 and not none %}yes{% else %}no{% endif %}{% for m in ms %}{{ loop.index0 }}{{ m.t | upper }}{% if loop.last %}.{% endif %}{% endfor %}")
    assert render({"ms": [{"t": "a"}, {"t": "b"}]})[0] == "xyyes0A1B."
    assert chat.simplified(chat.parse("{% if true %}a{{ 'b' }}{% endif %}c")) == [("text", "abc")]
    for wrong in ("{% for x %}{% endfor %}", "{{ a( }}", "{% if x %}", "{{ x | open }}", "{{ 'a' + 1 }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(wrong)
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ x.__class__ }}")({"x": 3})


def test_chat(spark):
    says = r"\### Assistant: </turn> ok"
    data = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, 0, "system", says), (2, None, None, "\\<>\\l"), (None, 3, "assistant", says), (4, 0, "assistant", "é" * 5000), (4, 1, "assistant", "")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, None, 4}
    for conv, r in got.items():
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in data if c == conv))
        assert chat.read_turns(r["formatted"]) == [(a, b) for _, a, b in own]
        loss = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert loss == [b for _, a, b in own if a == "assistant"]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ------------------------------------------------------------------------ op3


def test_mixing(spark, docs, nothing):
    rng = random.Random(3)
    data = [(i, sentence(rng, 30) + (" idiot fool" if i % 5 == 0 else ""), "bad" if i % 5 == 0 else "good") for i in range(300)]
    table = spark.createDataFrame(data, "doc_id long, text string, domain string")
    model = mixing.fit_domains(table, table.select("doc_id", "domain"))
    members = table.select("doc_id", mixing.membership("text", model).alias("m")).select("doc_id", "m.tokens", "m.p").cache()
    got = mixing.mixed(members, model, {"good": 0.95, "bad": 0.05}).collect()
    total = sum(r["tokens"] for r in got)
    meets = [sum(r["tokens"] * r["p"][k] * r["rate"] for r in got) / total for k in range(2)]
    assert abs(meets[0] - 0.05) < 0.01 and abs(meets[1] - 0.95) < 0.01 and min(r["rate"] for r in got) >= 0
    r = np.array([x["rate"] for x in got])
    c = np.array([x["copies"] for x in got])
    assert (np.abs(c - r) < 1).all()
    # the same descent on the dense problem
    p, tok = np.array([x["p"] for x in got]), np.array([x["tokens"] for x in got])
    target, x = np.array([0.05, 0.95]) * total, np.ones(len(got))
    for _ in range(40):
        now, free = (x * tok) @ p, x > 0
        if (np.abs(now - target) <= 0.01 * target).all():
            break
        x = np.maximum(x + p @ np.linalg.lstsq((p[free] * tok[free, None]).T @ p[free] / target[:, None], (target - now) / target, rcond=1e-3)[0], 0)
    assert np.abs(x - r).max() < 1e-4
    # bounds: likely good documents stay, the rest is thinned
    thin = mixing.mixed(members.selectExpr("*", "9 as rate", "'x' as copies"), model, {"good": 0.95, "bad": 0.05}, keep="good", thin=True).collect()
    assert all(t["rate"] == 1 == t["copies"] for t in thin if t["p"][1] >= 0.5) and max(t["rate"] for t in thin) <= 1
    good = sum(t["tokens"] * t["p"][1] for t in thin)
    assert abs(sum(t["tokens"] * t["p"][0] * t["rate"] for t in thin) - good * 0.05 / 0.95) <= 0.0101 * good * 0.05 / 0.95
    with pytest.warns(UserWarning, match="miss their targets"):  # no document can give what is asked for
        mixing.fit_rates(members.selectExpr("tokens", "p", "1D as low", "1D as high"), target)
    assert mixing.mixed(members.where("false"), model, {"good": 1.0}).count() == 0
    odd = docs.select(mixing.membership("text", model).alias("m")).collect()
    assert all(abs(sum(o["m"]["p"]) - 1) < 1e-9 for o in odd)
    assert mixing.fit_domains(nothing, table.select("doc_id", "domain")) is None
    assert {x["copies"] for x in mixing.mixed(members, None, {}).collect()} == {1}


# ------------------------------------------------------------------------ op4


def test_pieces(spark, docs, rows, nothing):
    sentencepiece = pytest.importorskip("sentencepiece")
    with open(MODEL, "rb") as f:
        raw = f.read()
    lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for chunk in (sentencepiece_scan.CHUNK, 64):  # the small one sends nearly all texts through the chunked path
        got = sentencepiece_scan.encode(docs, raw, ["n_chars", "lang"], chunk=chunk).collect()
        assert len(got) == len(rows)
        for r in got:
            text = rows[r["n_chars"]][1] or ""
            assert list(r["ids"]) == lib.encode(text) and r["decoded"] == text
    assert sentencepiece_scan.encode(nothing, raw, ["doc_id"]).count() == 0


def test_matrices_are_associative():
    with open(MODEL, "rb") as f:
        model = sentencepiece_scan.PieceModel.read(f.read())
    text = model.normal("Internationalisation of representation" * 3)
    cuts, size, far = [], 11, model.longest
    for a in range(0, len(text), size):
        left, body = text[max(0, a - far) : a], text[a : a + size]
        cuts.append(sentencepiece_scan._Cut(left + body + text[a + size : a + size + far], len(left), len(left) + len(body), a + size >= len(text)))
    a, b, c = [sentencepiece_scan.transfer(model, x) for x in cuts[:3]]
    prod = sentencepiece_scan.product
    assert prod(prod(a, b), c) == prod(a, prod(b, c))


def test_states_of_the_rounds(spark, monkeypatch):
    """Combining in rounds fixes the states that one run over all chunks fixes."""
    with open(MODEL, "rb") as f:
        model = sentencepiece_scan.PieceModel.read(f.read())
    monkeypatch.setattr(sentencepiece_scan, "FAN", 2)
    for size, text in ((11, "Internationalisation of representation" * 3), (5, "antidisestablishmentarianism" * 4), (50, "short")):
        text, far, entries, matrices = model.normal(text), model.longest, [], []
        for c, a in enumerate(range(0, len(text), size)):
            left, body = text[max(0, a - far) : a], text[a : a + size]
            cut = sentencepiece_scan._Cut(left + body + text[a + size : a + size + far], len(left), len(left) + len(body), a + size >= len(text))
            matrices.append(sentencepiece_scan.transfer(model, cut))
            entries += sentencepiece_scan._entries(7, c, matrices[-1])
        want = sentencepiece_scan.boundary_states(matrices)
        # the patched width is not seen by Python workers, so the kernels are called here
        import pandas as pd

        levels, columns = [pd.DataFrame(entries, columns=["uid", "chunk", "a", "ax", "b", "bx", "w"])], ["uid", "chunk", "a", "ax", "b", "bx"]
        while levels[-1]["chunk"].max() > 0:
            levels.append(pd.concat([sentencepiece_scan._combined(g) for _, g in levels[-1].groupby(levels[-1]["chunk"] // 2)]))
        end = max((w, e) for e, w in sentencepiece_scan._matrices_of(levels[-1])[0][sentencepiece_scan.START].items())[1]
        states = pd.DataFrame([(7, 0, *sentencepiece_scan.START, *end)], columns=columns)
        for level in levels[-2::-1]:
            states = pd.concat([sentencepiece_scan._fixed(states[states["chunk"] == b].rename(columns={"chunk": "block"})[["uid", "block", *columns[2:]]], g) for b, g in level.groupby(level["chunk"] // 2)])
        assert [(r.a, r.ax) for r in states.itertuples()] == want[:-1] and (states["b"].iat[-1], states["bx"].iat[-1]) == want[-1]


# ------------------------------------------------------------------------ op5


def brute_spans(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
        edges = [i for i in range(len(t) + 1) if (i > 0 and m[i - 1]) != (i < len(t) and m[i])]
        out.append(list(zip(edges[::2], edges[1::2], strict=True)))
    return out


def brute_later_spans(texts, places, length):
    """Spans of windows that start at an earlier place too; texts of one place are one document."""
    first = {}
    order = sorted(range(len(texts)), key=lambda k: places[k])
    for k in order:
        for i in range(len(texts[k]) - length + 1):
            first.setdefault(texts[k][i : i + length], (places[k], i))
    out = []
    for t, place in zip(texts, places, strict=True):
        m = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] != (place, i):
                m[i : i + length] = b"\1" * length
        edges = [i for i in range(len(t) + 1) if (i > 0 and m[i - 1]) != (i < len(t) and m[i])]
        out.append(list(zip(edges[::2], edges[1::2], strict=True)))
    return out


def spans_of(keyed, covers):
    got = keyed.join(covers, ["doc", "th", "tn"], "left").select("n_chars", "covers").collect()
    return {r["n_chars"]: suffix_dedup.merged_spans(np.array([[c["a"], c["b"]] for c in r["covers"] or []])) for r in got}


@pytest.mark.parametrize("crowd", [2000, 1])
def test_repeats(docs, rows, nothing, crowd):
    texts = [(t or "").encode() for _, t in rows]
    assert spans_of(*suffix_dedup.repeated_spans(docs, crowd=crowd)) == dict(enumerate(brute_spans(texts, 200)))
    th = [np.uint64(xxhash.xxh64_intdigest(t, 42)).view(np.int64) for t in texts]
    places = [(-(2**63) if i is None else i, int(h), len(t)) for (i, _), h, t in zip(rows, th, texts, strict=True)]
    later = dict(enumerate(brute_later_spans(texts, places, 200)))
    assert any(later.values()) and spans_of(*suffix_dedup.repeated_spans(docs, crowd=crowd, doc=F.col("doc_id"))) == later
    if crowd > 1:
        cut = suffix_dedup.without_repeats(docs).select("row.n_chars", "text", "spans").collect()
        assert len(cut) == len(rows)
        for r in cut:  # characters stay where only some of their bytes repeat
            own = suffix_dedup.whole_characters(texts[r["n_chars"]], later[r["n_chars"]])
            assert [(x["a"], x["b"]) for x in r["spans"]] == own and (r["text"] or "").encode() == suffix_dedup.kept_bytes(texts[r["n_chars"]], own)
        assert suffix_dedup.without_repeats(nothing).count() == 0


@pytest.mark.parametrize("crowd", [2000, 3])
def test_a_passage_of_a_third_of_all_texts(spark, crowd):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(90))
    texts = [" ".join(word() for _ in range(60)) for _ in range(60)]
    texts = [(t[:150] + passage[k % 7 : len(passage) - k % 5] + t[150:] if k % 3 == 0 else t) for k, t in enumerate(texts)] + ["ab" * 400, "x" * 900]
    docs = spark.createDataFrame([(100 - k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int").repartition(3)
    raw = [t.encode() for t in texts]
    assert spans_of(*suffix_dedup.repeated_spans(docs, crowd=crowd)) == dict(enumerate(brute_spans(raw, 200)))
    later = dict(enumerate(brute_later_spans(raw, [(100 - k,) for k in range(len(raw))], 200)))
    assert spans_of(*suffix_dedup.repeated_spans(docs, crowd=crowd, doc=F.col("doc_id"))) == later
    kept = [r["text"] for r in suffix_dedup.without_repeats(docs).collect()]
    assert sum(passage[10:-10] in t for t in kept) == 1


def test_longest_previous_factors():
    rng = random.Random(4)
    for n in (1, 2, 30, 200):
        text = "".join(rng.choice("ab") for _ in range(n))
        order = sorted(range(n), key=lambda i: text[i:])
        same = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or text[i + k] != text[j + k]), n)
        common = np.array([0] + [same(a, b) for a, b in zip(order, order[1:], strict=False)])
        got = suffix_dedup.previous_factors(np.array(order), common)
        assert {i: int(v) for i, v in zip(order, got, strict=True)} == {i: max((same(i, j) for j in range(i)), default=0) for i in range(n)}


def test_factors_alone_decide(monkeypatch):
    """Without longest previous factors nothing is removed, equal surroundings or not."""
    around = [b"a" * 150 + b"b" * 150, b"c" * 300]
    lo, hi, twice = np.array([60, 60]), np.array([0, 0]), np.array([True, False])
    for later_only in (True, False):
        first, _, later, _ = suffix_dedup.repeated_windows(around, lo, hi, twice, 200, later_only)
        assert list(later) == [60, -1] and list(first) == ([-1, 59] if later_only else [60, 60])  # windows of c...c are equal; the first is no later copy
    monkeypatch.setattr(suffix_dedup, "previous_factors", lambda place, common: np.zeros(len(place), np.int64))
    for later_only in (True, False):
        assert all((x == -1).all() for x in suffix_dedup.repeated_windows(around, lo, hi, twice, 200, later_only))


def test_texts_beyond_one_part():
    rng = random.Random(5)
    big = bytes(rng.randrange(97, 123) for _ in range(5000))
    data = [big, big[1000:1600]]
    found = {}
    for size in (700, 10_000):
        rows = []
        for raw, last, text, shift in suffix_dedup._parts(data, 200, size):
            at, _, _, h1, _ = suffix_dedup.anchors(raw, last, 200)
            rows += [(int(text[i]), int(i - shift[i]), int(h)) for i, h in zip(at, h1, strict=True)]
        found[size] = set(rows)
    assert found[700] == found[10_000]


# ------------------------------------------------------------------- op6, op7


def test_fingerprints(spark, docs, rows, nothing):
    single = docs.where(F.col("n_chars") < len(rows) - 5)  # every id once
    got = minhash.edited_fingerprints(single, buckets=5).orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in single.collect()}
    ids = sorted(texts)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for k, r in enumerate(got):
        t, n = texts[ids[k]], texts[ids[(k + 1) % len(ids)]]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (ids[k], len(t), hashlib.sha256(e.encode()).hexdigest())
        assert abs(r["near_edited"] - like(shingles(t), shingles(e))) < 0.2 and abs(r["near_next"] - like(shingles(t), shingles(n))) < 0.2
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert minhash.edited_fingerprints(docs).count() == len(rows) and minhash.edited_fingerprints(nothing).count() == 0


def minhash_by_hand(text):
    """A fingerprint from its definition, in plain Python."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    if not words:
        return ""

    def chained(parts):
        h = 42
        for x in parts:
            h = xxhash.xxh64_intdigest(x, h)
        return h - 2**64 if h >= 2**63 else h

    hashes = [chained(w.encode() for w in words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    empty, bins = (1 << 56) - 1, {}
    for h in hashes:
        if h & empty != empty:
            bins[(h >> 56) + 128] = min(bins.get((h >> 56) + 128, h), h)
    out = []
    for b in range(256):
        tries = [b, *(minhash.drawn(b, t) for t in range(minhash.ATTEMPTS))]
        donor = next((j for j in tries if j in bins), None)
        if donor is None:
            donor = min((chained((b.to_bytes(4, "little"), (j - 128).to_bytes(8, "little", signed=True))), bins[j], j) for j in bins)[2]
        out.append(f"{bins[donor] & 255:02x}")
    return "".join(out)


def test_fingerprint_digits(docs, rows):
    got = {r["n_chars"]: r["f"] for r in minhash.with_fingerprint(docs.select("n_chars", F.coalesce("text", F.lit("")).alias("t")), "t", "f").select("n_chars", minhash.packed(F.col("f")).alias("f")).collect()}
    assert got == {k: minhash_by_hand(t or "") for k, (_, t) in enumerate(rows)}


def test_edited_texts_by_sql(spark, tmp_path):
    """n_chars and edited_sha256 against SQL, on the whole small table."""
    import duckdb

    rng = random.Random(31)
    data = [(7 * k % 101, sentence(rng, rng.choice([0, 1, 7, 120])) if k % 9 else None) for k in range(101)]
    spark.createDataFrame(data, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(f"""
        with d as (select doc_id, coalesce(text, '') as t from read_parquet('{tmp_path}/documents.parquet/*.parquet')),
        n as (select doc_id, t, coalesce(lead(t) over (order by doc_id), first(t) over (order by doc_id)) as u, length(t) // 2 as h from d)
        select doc_id, length(t) as n_chars, sha256(left(t, length(t) - h) || left(u, h)) as edited_sha256 from n order by 1""").fetchall()
    got = minhash.edited_fingerprints(spark.read.parquet(f"{tmp_path}/documents.parquet"), buckets=7).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == want


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 1000])
def test_shards(spark, n):
    df = spark.range(n).select(F.when(F.col("id") % 10 == 3, None).otherwise(F.col("id") % 50).alias("k"))
    got = sharding.feistel_shards(df, ["k"], 8)
    again = sharding.feistel_shards(df.repartition(3), ["k"], 8)
    rows = sorted((str(r["k"]), r["row_no"], r["shard"], r["slot"]) for r in got.collect())
    assert rows == sorted((str(r["k"]), r["row_no"], r["shard"], r["slot"]) for r in again.collect()) and sorted(r[1] for r in rows) == list(range(n))
    sizes = collections.Counter(r[2] for r in rows)
    assert n < 8 or max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r[3] for r in rows if r[2] == s) == list(range(c)) for s, c in sizes.items())


def test_shards_do_not_depend_on_the_session(spark):
    df = spark.createDataFrame([(k % 40, None if k % 7 == 0 else f"t{k % 11}", k) for k in range(300)], "row_no long, b string, shard long")
    key, found = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    for n in ("3", "4", "11"):
        spark.conf.set(key, n)
        found.append(sorted(map(str, sharding.feistel_shards(df.repartition(int(n)), ["row_no", "b", "shard"], 8).collect())))
    spark.conf.set(key, before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 300
    odd = sharding.feistel_shards(df.selectExpr("row_no as _n", "b as _b", "shard as _first", "1 as hash", "2 as first"), ["_n", "_b", "_first"], 8)
    assert odd.columns == ["_n", "_b", "_first", "row_no", "shard", "slot"] and sorted(r["row_no"] for r in odd.collect()) == list(range(300))
    assert sharding.bucket_count(10) == 64 and sharding.bucket_count(10**12) == 2**20


def test_feistel_by_hand(spark):
    n, seed = 37, 5
    a, b = sharding.domain(n)

    def once(x):
        left, right = divmod(x, b)
        for i in range(1, sharding.ROUNDS + 1):
            half, size = (right, a) if i % 2 else (left, b)
            h = xxhash.xxh64_intdigest(f"{seed}:{i}:{half}".encode(), 42)
            noise = (h - 2**64 if h >= 2**63 else h) % size
            left, right = ((left + noise) % a, right) if i % 2 else (left, (right + noise) % b)
        return left * b + right

    def walk(x):
        y = once(x)
        while y >= n:
            y = once(y)
        return y

    got = [r[0] for r in spark.range(n).orderBy("id").select(sharding.permuted(F.col("id"), n, seed)).collect()]
    assert got == [walk(x) for x in range(n)] and sorted(got) == list(range(n))


# ------------------------------------------------------------------- op8, op9


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64)) if hs else 0


def test_simhash(docs, rows, nothing):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    codes = [by_hand(t) for _, t in rows]
    assert sorted(str((r["doc_id"], r["fp"] % 2**64)) for r in got) == sorted(str((i, c)) for (i, _), c in zip(rows, codes, strict=True))
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(codes):
            for j, b in enumerate(codes):
                if bin(a ^ b).count("1") <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    assert sorted(str((r["doc_id"], r["fp"] % 2**64, r["component_id"])) for r in got) == sorted(str((i, c, least[g])) for (i, _), c, g in zip(rows, codes, group, strict=True))
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 2, 5])
def test_index_finds_all_pairs(distance):
    rng = np.random.default_rng(distance)
    codes = rng.integers(0, 2**63, 150, dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, codes[:60] ^ (np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64)), codes[:40] ^ np.uint64(0b10011)]))
    group = rng.integers(0, 3, len(codes))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    got = {(int(a), int(b)) for x, y in simhash.linked_pairs(codes, group, distance) for a, b in zip(x, y, strict=True)}
    assert got == {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if group[i] == group[j] and bin(int(codes[i] ^ codes[j])).count("1") <= distance}


def test_long_chains_join(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_near_copies(spark):
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocab) for _ in range(300)] for _ in range(30)]
    data = []
    for k, words in enumerate(base):
        edited = words[:]
        for i in rng.sample(range(300), 3):
            edited[i] = "zz"
        data += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    docs = spark.createDataFrame([*data, (500, None), (501, ""), (0, data[0][1])], "doc_id long, text string")
    groups = simhash.near_copies(docs)
    kept = simhash.one_of_each(docs, groups).collect()
    ids = sorted(r["doc_id"] for r in kept)
    assert len([i for i in ids if i < 60 and i % 2 == 1]) <= 2 and all(i in ids for i in range(0, 60, 2)) and ids.count(0) == 1
    assert len([i for i in ids if i >= 500]) == 1


def edited(kind, rng, words, vocab):
    """A copy at a five-word Jaccard similarity just above 0.8, and that similarity."""
    n = len(words)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    own, best = sets(words), None
    order = rng.sample(range(n), n)
    for k in range(1, n):
        if kind == "appended":
            copy = words + [f"new{i}" for i in range(k)]
        elif kind == "replaced":
            copy = words[: n // 3] + [f"new{i}" for i in range(k)] + words[n // 3 + k :]
        else:
            copy = [("new" if i in order[:k] else w) for i, w in enumerate(words)]
        s = len(own & sets(copy)) / len(own | sets(copy))
        if s < 0.8:
            return best
        best = " ".join(copy), s
    return best


@pytest.mark.parametrize("kind", ["appended", "replaced", "scattered"])
def test_near_copies_at_the_limit(spark, kind):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    data = []
    for k in range(150):
        words = [rng.choice(vocab) for _ in range(300)]
        copy, s = edited(kind, rng, words, vocab)
        assert 0.8 <= s < 0.83
        data += [(2 * k, " ".join(words)), (2 * k + 1, copy)]
    groups = {r["doc_id"]: r["root"] for r in simhash.near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    found = sum(groups[2 * k] == groups[2 * k + 1] for k in range(150))
    assert found >= 0.93 * 150, found


def test_less_similar_texts_stay(spark):
    rng = random.Random(4)
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    data, template = [], [f"t{k}" for k in range(260)]
    for k in range(60):  # one template with an own end each: 256 of 308 shingles shared, a similarity of 0.71
        data.append(template + [f"d{k}x{i}" for i in range(52)])
    assert 0.7 < len(sets(data[0]) & sets(data[1])) / len(sets(data[0]) | sets(data[1])) < 0.72
    for k in range(60):
        words = [f"p{k}x{rng.randrange(500)}" for _ in range(300)]
        data += [words, words[:246] + [f"q{k}x{i}" for i in range(54)]]  # 0.69
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(data)], "doc_id long, text string")
    assert simhash.near_copies(docs).select("root").distinct().count() == len(data)


def test_hot_groups_are_bounded():
    codes = np.sort(np.random.default_rng(1).integers(0, 2**10, 3000).astype(np.uint64))
    codes = codes[np.argsort(simhash.gray_rank(codes), kind="stable")]
    blocks = [len(a) for a, _ in simhash.linked_pairs(codes, np.zeros(3000, np.int64), 64, most=100_000)]
    assert max(blocks) <= 100_000 and sum(blocks) == 3000 * 2999 // 2


def test_hot_groups_keep_all_links(spark):
    """A chain of windows over one long text: neighbours are similar, the ends are not, and keys are crowded."""
    rng = random.Random(8)
    words = [f"c{rng.randrange(5000)}" for _ in range(900)]
    data = [" ".join(words[at : at + 300]) for at in range(0, 600, 4)]
    data += [" ".join(words[:300] + [f"v{k}"]) for k in range(60)]
    data += [" ".join(words[:170] + [f"u{k}x{i}" for i in range(130)]) for k in range(5)]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r["doc_id"]: r["root"] for r in simhash.near_copies(docs, crowd=8, cell=7).collect()}
    whole = {r["doc_id"]: r["root"] for r in simhash.near_copies(docs).collect()}
    groups = lambda g: {frozenset(i for i in g if g[i] == r) for r in g.values()}
    assert groups(got) == groups(whole) and len(groups(got)) == 6


def test_topk(spark):
    rng = np.random.default_rng(4)
    vecs = [(i, [float(x) for x in rng.normal(0, 1, 16)]) for i in range(300)]
    vecs += [(i, v) for i, v in [(300, vecs[0][1]), (301, vecs[0][1]), (302, None), (303, [float("nan")] * 16), (304, [float("inf")] + [0.0] * 15), (305, []), (None, vecs[1][1])]]
    vecs += [(306, [None] * 16)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    ints = {r["vec_id"]: list(r["v"]) for r in df.collect() if r["vec_id"] is not None and r["v"] is not None}
    ints[305] = [0] * 16  # an empty vector takes part
    assert not {302, 303, 304, 306} & set(ints)
    want = []
    for q in (i for i in ints if i % 20 == 0):
        best = sorted(((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q))[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for query_block in (4, 8192):  # several blocks of queries, and one
        got = topk.exact_topk(df.where("vec_id % 20 = 0"), df, "vec_id", "v", 20, query_block=query_block, row_block=50, least_blocks=3).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk.exact_topk(df.where("false"), df.where("false"), "vec_id", "v", 20).count() == 0
    few = df.where("vec_id < 3")
    assert topk.exact_topk(few, few, "vec_id", "v", 20).count() == 6


def test_topk_of_groups_ships_fewer_blocks(spark):
    """Vectors in groups apart: some blocks cannot reach a query's k-th score and are not sent to it."""
    rng = np.random.default_rng(9)
    middles = rng.normal(0, 3, (8, 16))
    vecs = [(i, (middles[i % 8] + rng.normal(0, 0.1, 16)).round(3).tolist()) for i in range(800)] + [(800 + i, middles[0].round(3).tolist()) for i in range(60)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").select("vec_id", topk.scaled(F.col("embedding")).alias("v")).cache()
    asked = df.where("vec_id % 20 = 0")
    got = topk.exact_topk(asked, df, "vec_id", "v", 5, query_block=8, row_block=40).collect()
    ints = {r["vec_id"]: np.array(r["v"]) for r in df.collect()}
    want = [(q, k + 1, i, -s) for q in ints if q % 20 == 0 for k, (s, i) in enumerate(sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    rows = df.select(F.col("vec_id").alias("id"), "v")
    q_side, r_side = topk._dealt(rows.where("id % 20 = 0"), rows, 860, 16, 5, 8, 40)
    blocks = r_side.select("rb").distinct().count()
    assert q_side.count() < 0.85 * 43 * blocks


def test_fold_is_crc(spark):
    from lattica.llm.common import fold

    got = spark.createDataFrame([(5,), (None,), (77,)], "doc_id long").select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 for r in got)


def test_signs_above_the_first_plane_are_no_letters(spark):
    train = spark.createDataFrame([(i, "bado bedi " * 20 + "𝒳 𐐀" * (i % 2), "aa") for i in range(20)] + [(100 + i, "kirt krst " * 20, "zz") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.fit_languages(train)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "😀😀"), (2, "😀 12 !"), (3, "😀 bado bedi bado"), (4, "𐐀𐐁")], "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert got[1] == got[2] == "und" and got[3] == "aa" and got[4] in ("aa", "zz")
