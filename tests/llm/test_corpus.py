import base64
import gzip
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

import corpus_pipeline
from fixlake.llm import decontaminate, language_id, quality, warc


def test_warc_round_trip(spark):
    big = "é" * 300_000
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/ c", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", big), (5, "u", big), (-7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "<p>x</p>"), (None, "n", "own")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, bytes string")
    folder = warc.archive_folder(spark)
    manifest = warc.write_warc(df, folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(manifest, folder).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        last = max((k for k, _, h in rows if (h or "") == (html or "") and k is not None), default=None)
        refers = last if last is not None and last != i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want, key=repr)
    chunks = warc.read_warc_chunks(manifest, folder).where("page_id = 5 AND record_type = 'response'").orderBy("chunk_no").collect()
    one = b"".join(bytes(r.chunk) for r in chunks)
    assert one.count("é".encode()) == 600_000 and max(len(r.chunk) for r in chunks) <= warc.CHUNK
    one = big.encode()  # of two equal records, whose chunks come in pairs
    files, _ = pafs.FileSystem.from_uri(folder)
    raw = b"".join(gzip.decompress(files.open_input_file(r.path).read()) for r in manifest.collect())
    assert raw.count(b"WARC-Type: response") == sum(w[3] == "response" for w in want) and raw.count(b"WARC-Type:") == len(rows)
    ends = {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_warc(manifest, folder).collect()}
    assert all(c.digest_so_far == base64.b32encode(hashlib.sha1(one[: c.bytes_so_far]).digest()).decode() for c in chunks[: len(chunks) // 2] if c.bytes_so_far <= 600_000) and len(ends) == len({(w[0], w[1], w[2]) for w in want})
    written = warc.chunk_rows(df, chunk=1000).where("page_id = 5").orderBy("record", "chunk_no").collect()
    assert len(written) == 1200 and b"".join(bytes(r.chunk) for r in written[:600]) == big.encode() and written[599].digest_so_far == written[0].digest
    assert warc.read_warc(warc.write_warc(df.limit(0), folder), folder).collect() == []


def test_warc_least_and_damage(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abcd"), (4, "abcd")], "page_id long, html string")
    folder = warc.archive_folder(spark)
    manifest = warc.write_warc(df, folder, url=None, least=3)
    assert {r.page_id: r.record_type for r in warc.read_warc(manifest, folder).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    files, _ = pafs.FileSystem.from_uri(folder)
    path = manifest.first().path
    data = files.open_input_file(path).read()
    with files.open_output_stream(path, compression=None) as out:
        out.write(data[:-9])
    with pytest.raises(Exception, match="archive ends"):
        warc.read_warc(manifest, folder).collect()


def plain_overlap(words, item, least=decontaminate.MIN_WORDS, share=decontaminate.SHARE):
    best = 0
    for start in range(-len(item) + 1, len(words)):
        same = [words[start + i] == item[i] for i in range(len(item)) if 0 <= start + i < len(words)]
        for a in range(len(same)):
            for b in range(a + min(least, len(item)), len(same) + 1):
                if sum(same[a:b]) >= share * (b - a) - 1e-9:
                    best = max(best, b - a)
    return best


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(14, 40)))) for i in range(8)] + [(8, "short item of five"), (9, ""), (10, None), (11, "... !!!")]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            item = rng.choice(items[:9])[1].split()
            if i % 2 and len(item) > 12:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = item
        rows.append((i, " ".join(words).title() + "."))
    rows += [(100, None), (101, ""), (None, items[0][1]), (5, rows[5][1])]
    df, benchmark = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.contaminated, r.items, r.longest) for r in decontaminate.find_contaminated(df, benchmark).collect()), key=repr)
    want = []
    for i, t in rows:
        words = [w for w in (t or "").lower().replace(".", "").split()]
        hit = {k: n for k, x in items[:9] if (n := plain_overlap(words, x.lower().split()))}
        want.append((i, bool(hit), ",".join(map(str, sorted(hit))), max(hit.values(), default=0)))
    want = sorted(want, key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want] and got == want
    kept = decontaminate.decontaminate(df, benchmark)
    assert kept.columns == df.columns and sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(w[0]) for w in want if not w[1])
    assert decontaminate.find_contaminated(df, benchmark.limit(0)).where("contaminated").count() == 0 and decontaminate.find_contaminated(df.limit(0), benchmark).count() == 0


def test_decontamination_misses_no_placement():
    """Any fifth of an item's words can be substituted, and every fifth of an item of any length."""
    for n in range(5, 61):
        benchmark = decontaminate.Benchmark([(1, " ".join(f"i{k}" for k in range(n)))])
        places = itertools.combinations(range(n), n // 5) if n < 17 else (range(at, n, 5) for at in range(n % 5, 5))
        for gone in places:
            words = decontaminate.Words().hashes("before it " + " ".join(f"x{k}" if k in gone else f"i{k}" for k in range(n)) + " after it")
            assert [i for i, _, _ in benchmark.check(words)] == [1], (n, list(gone))


def test_decontamination_in_parts(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(6)]
    df = spark.createDataFrame([(0, "x " + items[1][1] + " y " + items[4][1]), (1, "clean text")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.find_contaminated(df, benchmark).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "PART_BYTES", 250)
    assert decontaminate.find_contaminated(df, benchmark).orderBy("doc_id").collect() == whole and whole[0]["items"] == "1,4"
    assert decontaminate.overlaps(df, benchmark)._jdf.queryExecution().toString().count("MapInArrow") <= 4  # one stage, in each of four plans


def test_decontamination_of_repeated_words():
    benchmark = decontaminate.Benchmark([(1, "a " * 300), (2, "a b " * 40)])
    assert [i for i, _, _ in benchmark.check(decontaminate.Words().hashes("a " * 3000))] == [1]
    assert [i for i, _, _ in benchmark.check(decontaminate.Words().hashes("b a " * 3000))] == [2]
    assert benchmark.check(decontaminate.Words().hashes("c " * 3000)) == []


def good_text(rng):
    return " ".join(rng.choice(["river", "stone", "market", "people", "walked", "under", "morning", "light"]) for _ in range(80)) + "."


def bad_text(rng):
    return "".join(rng.choice(["buy!!", "$$$", "NOW!!", "###", "click&&&"]) + " " for _ in range(80))


def test_quality_learns(spark):
    rng = random.Random(2)
    rows = [(i, bad_text(rng) if i % 4 == 0 else good_text(rng), "en", "s") for i in range(400)] + [(1000, None, "en", "s"), (1001, "", None, None), (None, "x", "en", "s"), (1002, "y" * 200_000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(1, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(400)) and np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values()) and len(got) == len(rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id < 400").count() == sum(got[i].predicted for i in range(400))
    one = quality.fit({0: [bad_text(rng)] * 2, 1: [good_text(rng) * 400] * 2}, {0: 1, 1: 3})
    assert 0 <= one.score("") <= 1 and one.score("") == one.score(None)
    assert quality.learn(docs, labels.where("quality = 1")).score("x") == 1.0 and quality.learn(docs, labels.limit(0)).score("x") == 0.5
    assert quality.score_quality(docs.limit(0), model).collect() == []


def test_quality_equals_a_plain_loop():
    """Scores from the model's dictionaries, by plain compression of each block and a plain logistic function."""
    import math

    import zstandard

    rng = random.Random(5)
    model = quality.fit({0: [bad_text(rng) for _ in range(40)], 1: [good_text(rng) for _ in range(60)]}, {0: 40, 1: 60})
    for text in (good_text(rng), bad_text(rng), "x", "é" * 700, good_text(rng) + bad_text(rng), ""):
        data, x = text.encode(), []
        for (good, bad), prior in zip(model.pairs, model.prior, strict=True):
            total = 0
            for at in range(0, len(data), 256):
                sizes = []
                for d in (good, bad):
                    kept = zstandard.ZstdCompressionDict(d)
                    kept.precompute_compress(level=3)
                    sizes.append(len(zstandard.ZstdCompressor(dict_data=kept, write_content_size=False, write_dict_id=False).compress(data[at : at + 256])))
                total += sizes[1] - sizes[0]
            x.append((total + 64 * prior) / (len(data) + 64))
        r = model.regression
        z = r.beta[0] + sum(b * (v - m) / s for b, v, m, s in zip(r.beta[1:], x, r.mean, r.scale, strict=True))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    assert model.score(good_text(rng)) > 0.5 > model.score(bad_text(rng))


def test_windows_cover_whole_texts(spark):
    """A long text is learnt from by one of all its windows, a short one as a whole."""
    df = spark.createDataFrame([(i, "".join(chr(97 + k // 10) for k in range(100))) for i in range(200)] + [(900, "ab"), (901, ""), (902, None)], "k long, t string")
    got = {r.k: r.w for r in df.select("k", quality.window(df.t, df.k, 10, 1).alias("w")).collect()}
    assert {got[i] for i in range(200)} == {chr(97 + i) * 10 for i in range(10)} and [got[i] for i in (900, 901, 902)] == ["ab", "", None]


def test_no_window_is_short(spark):
    """Also where the size doesn't divide the length, every window has the whole size, and all windows together have the whole text."""
    text = "".join(chr(97 + i % 26) for i in range(20_001))
    df = spark.range(200).withColumn("text", F.lit(text))
    found = {r[0] for r in df.select(quality.window(F.col("text"), F.col("id"), 10_000, 3)).collect()}
    assert {len(w) for w in found} == {10_000} and len(found) == 3
    assert any(text.endswith(w) for w in found) and any(text.startswith(w) for w in found)



WORDS = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zwei", "schnell", "strasse", "zug"], "cc": ["été", "français", "où", "garçon"]}


def test_languages(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 40))), lang) for i, lang in ((i, rng.choice(list(WORDS))) for i in range(300))]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 -- 4", None), (1003, "LOREM " * 5, None), (None, "zwei", "bb"), (1004, "x" * 5000, "aa")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, score string")
    model = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.98 and all(got[i].held_out for i, _, _ in held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    one = language_id.learn(docs.where("lang = 'bb'"))
    assert {r.lang_pred for r in language_id.identify(docs.where("doc_id < 50"), one).collect()} == {"bb"}
    none = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    from collections import Counter

    model = language_id.KneserNey(Counter({"ab": 3, "abc": 2, "b": 1, "ca": 1}), 5, order=3)
    for prefix in ("", "a", "ab", "ca", "bb"):
        total = 0.0
        for end in ("a", "b", "c", None):
            word = prefix + (end or "")
            (grams,) = language_id.grams_of([word], 5)
            at = len(prefix) + 1
            p = 1 / 5
            for n, (keys, probability, contexts, weight) in enumerate(model.tables, 1):
                if at >= max(1, n - 1):
                    p = float(language_id._looked_up(keys, probability, grams.hashes(n)[at : at + 1], 0.0)[0] + language_id._looked_up(contexts, weight, grams.hashes(n - 1, 1)[at : at + 1], 1.0)[0] * p)
            total += p
        assert total == pytest.approx(1 - _unseen(model, prefix), abs=1e-9)


def _unseen(model, prefix):
    """What the even distribution gives the one symbol that is not in the words."""
    (grams,), at, p = language_id.grams_of([prefix + "ሴ"], 5), len(prefix) + 1, 1 / 5
    for n, (_, _, contexts, weight) in enumerate(model.tables, 1):
        if at >= max(1, n - 1):
            p *= float(language_id._looked_up(contexts, weight, grams.hashes(n - 1, 1)[at : at + 1], 1.0)[0])
    return p


def plain_kneser_ney(counts, alphabet, order):
    """The probability of a symbol after a context, from dictionaries of n-grams as strings."""
    from collections import Counter

    occurs, before = [Counter() for _ in range(order + 1)], [{} for _ in range(order + 1)]
    for word, n in counts.items():
        marked = "^" + word + "$"
        for end in range(1, len(marked)):
            for size in range(1, min(order, end + 1) + 1):
                gram = marked[end - size + 1 : end + 1]
                occurs[size][gram] += n
                if end - size >= 0:
                    before[size].setdefault(gram, set()).add(marked[end - size])
    values = [None]
    for size in range(1, order + 1):
        use = {}
        for gram, n in occurs[size].items():
            use[gram] = n if size == order or gram[0] == "^" and size > 1 else len(before[size].get(gram, ())) or min(n, 1)
        values.append(use)

    def probability(context, symbol):
        p = 1 / alphabet
        for size in range(1, order + 1):
            if size - 1 > len(context):
                break
            history = context[len(context) - size + 1 :]
            after = {g: v for g, v in values[size].items() if g[:-1] == history}
            one, two = (sum(v == k for v in values[size].values()) for k in (1, 2))
            discount = one / (one + 2 * two) if one and two else 0.5
            total = sum(after.values())
            if total:
                p = max(after.get(history + symbol, 0) - discount, 0) / total + discount * len(after) / total * p
        return p

    return probability


def test_language_models_against_plain_dictionaries():
    from collections import Counter

    rng = random.Random(8)
    texts = [(lang, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "en"]) for _ in range(30))) for lang in WORDS for _ in range(5)]
    model = language_id.fit(texts)
    kept = {lang: [t for k, t in texts if k == lang][:4] for lang in WORDS}  # the fifth one calibrates
    counts = {lang: sum((Counter(t.split()) for t in ts), Counter()) for lang, ts in kept.items()}
    alphabet = len({c for words in counts.values() for w in words for c in w}) + 2
    plain = {lang: plain_kneser_ney(c, alphabet, 5) for lang, c in counts.items()}
    for text in ("lorem zwei", "été", "strassen dolor amets", "qqq"):
        for step in (language_id.STEP, 4):  # in one step, and with words cut into steps
            words, (entropy, symbols) = text.split(), model.entropies([text])[0]
            want = []
            for lang in model.names:
                logs = [np.log(plain[lang](("^" + w + "$")[max(0, at - 4) : at], ("^" + w + "$")[at])) for w in words for at in range(1, len(w) + 2)]
                want.append(-sum(logs) / len(logs))
            assert entropy == pytest.approx(want, abs=1e-9) and symbols == sum(len(w) + 1 for w in words), (text, step)
            for m, lang in zip(model.models, model.names, strict=True):
                total = np.zeros(len(words))
                for grams in language_id.grams_of(words, 5, step):
                    total += m.log_probabilities(grams, len(words), [(grams.hashes(n), grams.hashes(n - 1, 1)) for n in range(1, 6)])
                assert total == pytest.approx([sum(np.log(plain[lang](("^" + w + "$")[max(0, at - 4) : at], ("^" + w + "$")[at])) for at in range(1, len(w) + 2)) for w in words], abs=1e-9)


def test_words_do_not_depend_on_the_text_around_them():
    text = "İstanbul ΟΔΟΣ ΟΔΟΣΑ. " * 50 + "x" * 300 + " Straße"
    whole = language_id.word_counts(text)
    assert whole["i̇stanbul"] == 50 and whole["x" * 300] == 1
    for size in (1, 7, 64, 1000):
        assert language_id.word_counts(text, size) == whole
    rng = random.Random(1)
    model = language_id.fit([(lang, " ".join(rng.choice(WORDS[lang]) for _ in range(50))) for lang in WORDS for _ in range(5)])
    model._learn([language_id.Counter({"lorem" * 200_000: 1})])  # a word of a million letters
    assert model.predict(["lorem" * 200_000])[0][0] == "aa"


def test_no_language_is_left_out(spark):
    rows = [(10 * i + k, chr(0x4E00 + i) * 5, f"l{i}") for i in range(450) for k in range(10)]
    found = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 400)
    assert len({lang for lang, _ in found}) == 450


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    item = " ".join(f"test{i}" for i in range(30))
    rows = [(i, bad_text(rng) if i % 5 == 0 else good_text(rng) + f" own{i}", "en", "s", 10) for i in range(100)]
    copy = good_text(rng)[:-1] + " copied."
    rows += [(200, copy, "en", "s", 1), (201, copy, "en", "s", 1), (202, good_text(rng) + item + good_text(rng), "en", "s", 1), (203, None, "en", "s", 0), (None, good_text(rng), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(100)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe_encoding"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the copy lost its one long line and went; an empty document is no emptied one, and stays
    assert {200, 201, 202, 203, None} & set(got) == {200, 203, None} and got[203].n_tokens == 0 and not set(range(0, 100, 5)) & set(got)
    # clean documents stay, but for near copies by the exact similarity of what the stages before leave of them
    cleaned = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, corpus_pipeline.quality_filter(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)), str(tmp_path)).collect()}
    shingles = {i: {tuple((t or "").lower().split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for i, t in cleaned.items() if i is not None}
    near = {i for i in shingles for j in shingles if j < i and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])}
    assert set(got) - {None} == set(shingles) - near - {202}
    assert got[200].decoded_sha256 == hashlib.sha256(copy.encode()).hexdigest()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
