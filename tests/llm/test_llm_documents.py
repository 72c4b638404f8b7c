"""Archives, quality rules, classifier, language model, chat windows and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from compare import connect, differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.llm import chat, merkle, ppm, quality, warc, weaklabels
from palisade.llm.registry import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles()))
def test_same_as_sql(spark, small, name):
    assert differences(queries()[name](spark, small).toPandas(), connect(small).execute(oracles()[name]).df()) is None


# --- archives

PAGES = [
    (5, "http://a/ü x\r\nWARC-Type: warcinfo", "same"), (3, "http://b/", "same"), (None, None, "same"), (3, "http://b/", "same"),
    (7, "http://c/", None), (8, "", ""), (9, "http://d/", "\r\n\r\nWARC/1.1\r\n" + "é" * 400_000), (10, "http://e/", "Content-Length: 3\r\n\r\n"), (None, "http://f/", "no id"),
]


def archives(spark, tmp_path, **options):
    pages = spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, id int, payload string").repartition(3)
    return warc.write_archives(pages, str(tmp_path / "bundles"), **options)


def test_archives_come_back(spark, tmp_path):
    index = archives(spark, tmp_path)
    rows = warc.read_archives(index).collect()
    assert len(rows) == len(PAGES) and all(r["intact"] in (True, None) for r in rows)
    first = {}
    for key, _, payload in PAGES:
        if key is not None:
            first[payload or ""] = min(key, first.get(payload or "", key))
    wanted = []
    for key, _, payload in PAGES:
        data = (payload or "").encode()
        head = first.get(payload or "")
        revisit = head is not None and key != head
        wanted.append((str(key), len(data), warc.digest(data), "revisit" if revisit else "response", str(head) if revisit else "None", None if revisit else data))
    assert sorted(((str(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]), r["payload"]) for r in rows), key=str) == sorted(wanted, key=str)


def test_short_payloads_are_no_revisits(spark, tmp_path):
    rows = warc.read_archives(archives(spark, tmp_path, least_bytes=5)).collect()
    assert {r["record_type"] for r in rows} == {"response"}


def test_one_record_by_its_offsets(spark, tmp_path):
    index = archives(spark, tmp_path)
    assert sorted(r["id"] for r in warc.fetch_records(index.where("id IN ('9', '10')")).collect()) == ["10", "9"]
    for name in {r["bundle"] for r in index.collect()}:
        system, path = warc.filesystem(name)
        with system.open_input_file(path) as source:
            sizes = warc.frame_sizes(source, system.get_file_info(path).size)
        frames = sorted({(r["frame"], r["frame_start"], r["frame_bytes"]) for r in index.collect() if r["bundle"] == name})
        starts = np.cumsum([0, *(s for s, _ in sizes)])
        assert frames == [(i, int(starts[i]), size) for i, (size, _) in enumerate(sizes)]


def test_damage_is_told(tmp_path):
    good = warc.record("1", "u", b"abc", None, False, "d")
    for bad in (b"x" + good, good[:-6], good.replace(b"abc", b"ab")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    (tmp_path / "f").write_bytes(b"0" * 50)
    with warc.filesystem(str(tmp_path))[0].open_input_file(str(tmp_path / "f")) as source, pytest.raises(ValueError):
        warc.frame_sizes(source, 50)


def test_no_pages(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert index.count() == 0 and warc.read_archives(index).count() == 0


# --- quality rules

TEXTS = [
    None, "", " \t\n", "one", "a b c d e", "a b c d e f", "x y z u v x y z u v", "a a a a a a a a a a a a", "x " * 50, "Ünï cödé wörds are fine here, and more of them follow",
    "line\nline\n\nline\n \nother line with words", "SHOUTING ALL OF THE TIME IN EVERY WORD OF THE TEXT", "#a *b $c %d &e |f <g >h i j k", "wow! yes! no! so! to! be! it! is! an! ox!",
    "word\x0bword\x0cword\rword\tword word", "\x85 no\xa0break is no white space", "p q r s t " + " ".join(f"w{i}" for i in range(20_000)) + " p q r s t",
]


def plain_measurements(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measurements_like_brute_force(spark):
    r = random.Random(2)
    more = [" ".join(r.choices("abc", k=r.randrange(60))) for _ in range(200)]
    rows = [*enumerate(TEXTS + more), (None, "null id"), (0, "repeated id")]
    docs = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "doc_id long, text string, n_words int, failed int, m string")
    found = quality.ledger(docs).select("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, found)) == sorted(plain_measurements(t) for _, t in rows)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    names = quality.apply_policy(quality.ledger(docs), quality.POLICIES["v2"]).where("kept").count()
    assert kept.count() == names


def test_policies_and_ablations(spark):
    ledger = quality.ledger(spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string"))
    bits = [r["failed"] for r in ledger.collect()]
    found = {(r["version"], r["rule"]): (r["n_failed"], r["n_only"], r["n_kept"], r["n_kept_without"]) for r in quality.ablations(ledger).collect()}
    for version, names in quality.POLICIES.items():
        whole = quality.mask(names)
        assert quality.apply_policy(ledger, names).where("kept").count() == sum(b & whole == 0 for b in bits)
        for name in names:
            bit = quality.mask((name,))
            assert found[version, name] == (sum(b & bit != 0 for b in bits), sum(b & whole == bit for b in bits), sum(b & whole == 0 for b in bits), sum(b & whole & ~bit == 0 for b in bits))
    assert quality.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(KeyError):
        quality.mask(("no such rule",))


def test_rules_run_without_python(spark, small):
    plan = queries()["op2_rule_ledger"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- classifier


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(5)
    bad = rng.random(50_000) < 0.2
    right = (0.9, 0.7, 0.8, 0.85)
    counts = Counter()
    for kind in bad:
        votes = [0 if rng.random() < 0.3 else (2 if (rng.random() < p) == kind else 1) for p in right]
        counts[sum(v * 3**i for i, v in enumerate(votes))] += 1
    model = weaklabels.label_model(counts, 4, trusted=None)
    assert abs(model.share - 0.2) < 0.03
    for i, p in enumerate(right):
        assert abs(model.says[1, i, 2] / model.says[1, i, 1:].sum() - p) < 0.04
    assert model.posterior(2 + 6 + 18 + 54) > 0.95 and model.posterior(1 + 3 + 9 + 27) < 0.01
    assert 0 < weaklabels.label_model({}, 3).posterior(0) < 0.2


def test_classifier_on_held_out_labels(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    known, hidden = labels.where("doc_id % 2 = 0"), {r["doc_id"]: r for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [r for r in weaklabels.classify(docs, weaklabels.fit(docs, known)).collect() if r["id"] in hidden]
    clean = [r["kept"] for r in rows if hidden[r["id"]]["quality"] and not hidden[r["id"]]["toxic"]]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    insulting = [r["kept"] for r in rows if len(set(weaklabels._INTELLECT(texts[r["id"]].lower()) + weaklabels._WORTH(texts[r["id"]].lower()))) > 1]
    assert sum(clean) > 0.97 * len(clean) and sum(insulting) < 0.1 * len(insulting)


def test_classifier_takes_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5, "s"), (None, "null id you idiot", 0.5, "s"), (2, "x" * 100_000, 0.5, "s"), (2, "퟿ ünï", 0.5, "s")], "doc_id long, text string, toxic double, s string")
    labels = spark.createDataFrame([(1, None, None), (2, 0, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scorer = weaklabels.fit(docs, labels)
    assert weaklabels.classify(docs, scorer).count() == 4
    assert weaklabels.keep_clean(docs, scorer).columns == docs.columns
    empty = spark.createDataFrame([], "doc_id long, text string")
    scorer = weaklabels.fit(empty, None)
    assert weaklabels.classify(empty, scorer).count() == 0 and scorer.score("plain words") < (0.5, 0.5)


# --- language model


class PlainTrie:
    """Prediction by partial matching, straight from its definition."""

    def __init__(self, datas):
        self.seen = {}
        for data in datas:
            padded = bytes([ppm.START]) * ppm.ORDER + data
            for i in range(ppm.ORDER, len(padded)):
                for k in range(ppm.ORDER + 1):
                    self.seen.setdefault(padded[i - k : i], Counter())[padded[i]] += 1

    def log10(self, context, symbol):
        excluded, total = set(), 0.0
        for k in range(ppm.ORDER, -1, -1):
            counts = self.seen.get(context[len(context) - k :], Counter())
            left = {s: n for s, n in counts.items() if s not in excluded}
            mass, kinds = sum(left.values()), len(left)
            if symbol in left:
                return total + math.log10((left[symbol] - 0.5) / mass)
            if kinds:
                total += math.log10(0.5 * kinds / mass)
            excluded |= set(left)
        return total - math.log10(ppm.SYMBOLS - len(excluded))

    def score(self, data):
        padded = bytes([ppm.START]) * ppm.ORDER + data
        return sum(self.log10(padded[i - ppm.ORDER : i], padded[i]) for i in range(ppm.ORDER, len(padded)))


def plain_scores(rows):
    read = [(key, (text or "").encode().lower().split()) for key, text in rows]
    out = [zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1 for key, _ in read]
    counts = Counter(w for (_, words), held in zip(read, out) if not held for w in [*words, b"\n"])
    total, kinds = sum(counts.values()), len(counts)
    trie = PlainTrie([b" ".join(words) + bytes([ppm.END]) for (_, words), held in zip(read, out) if not held])
    found = []
    for (key, words), held in zip(read, out):
        tokens = [*words, b"\n"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        found.append((str(key), held, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6), round(trie.score(b" ".join(words) + bytes([ppm.END])), 6)))
    return sorted(found)


def scored(frame):
    return sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in frame.collect())


@pytest.mark.parametrize("limits", [{}, {"HEAVY_WORDS": 5, "CHUNK": 64, "KEPT_KEYS": 300, "KEPT_WORDS": 10}, {"SHARD_ROWS": 20, "CHUNK": 64, "SPAN": 2}])
def test_scores_like_the_definition(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ppm, name, value)
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["The", "cat", "Sat", "on", "é", "mat.", "rare%d" % i], k=r.randrange(30)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "no id"), (3, "repeated id"), (103, "z" * 500)]
    docs = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in rows], "doc_id long, text string, row int, n string, word int").repartition(3)
    assert scored(ppm.score_documents(docs)) == plain_scores(rows)


def test_probabilities_sum_to_one():
    datas = [b"abracadabra" + bytes([ppm.END]), b"the cat" + bytes([ppm.END])]
    levels, keys, counts = [], [], []
    for k in range(ppm.ORDER + 1):
        for full, n in Counter(int(x) for found, _ in ppm.strings(datas, ppm.ORDER) for x in found & np.uint64((1 << 8 * (k + 1)) - 1)).items():
            levels.append(k), keys.append(full), counts.append(n)
    model = ppm.Model(np.array(levels), np.array(keys, np.int64), np.array(counts), ppm.ORDER)
    for context in (b"\xff\xff\xffabr", b"zzzzz", b"dabra", b"e cat", b"\xff\xff\xff\xff\xff"):
        asked = np.array([int.from_bytes(context[-5:] + bytes([s]), "big") for s in range(255)], np.uint64)
        assert abs((10 ** model.log10(asked)).sum() - 1) < 1e-9


def test_every_string_is_in_one_of_many_shards(spark, tmp_path):
    docs = spark.createDataFrame([(f"some words and more of the {w}",) for w in ("cat", "dog", "cow")], "text string")
    counts = ppm.count_strings(docs).cache()
    whole, cut = ppm.write_trie(counts, str(tmp_path / "whole")), ppm.write_trie(counts, str(tmp_path / "cut"), most=10)
    assert len(whole.paths) == 1 and len(cut.paths) > 5 and whole.n_strings == cut.n_strings
    held = [ppm.Model.read(p, ppm.ORDER) for p in cut.paths]
    assert sum(len(m.strings[k][0]) for m in held for k in range(2, 6)) + sum(len(held[0].strings[k][0]) for k in (0, 1)) == cut.n_strings
    for context in (b"d mor", b"\xff\xff\xffso", b"zzzzz", b"zz\x00\x00\x00", b"f the"):
        asked = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(255)], np.uint64)
        one, many = whole.log10([asked])[0], cut.log10([asked, asked[:0]], True)[0]
        assert np.array_equal(one, many) and abs((10**one).sum() - 1) < 1e-9


def test_score_query(spark, small):
    rows = queries()["op8_partial_matching"](spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    held = [r for r in rows if r["held_out"]]
    length = {r["doc_id"]: len(" ".join((r["text"] or "").encode().lower().decode().split())) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert 0 < -sum(r["score"] for r in held) < 0.8 * sum(length[r["doc_id"]] for r in held)  # under 2.7 bits a character, from few texts
    assert ppm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- chat windows

TURNS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", None, "[:]x", "a\nb"]), st.lists(st.one_of(st.sampled_from([*chat.MARKS, "␛", "␛0", "␛1", "[", "<", "/s>", "INST]"]), st.text(max_size=4)), max_size=8).map("".join)), max_size=8)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_template_comes_back(turns):
    formatted = chat.BEGIN + "".join(chat.write_turn(r, t)[0] for r, t in turns)
    assert chat.read_turns(formatted) == turns
    for role, text in turns:
        written, low, high = chat.write_turn(role, text)
        assert chat.unescape(written[low:high]) == text and not any(m in chat.escape(text) for m in chat.MARKS)


CONVERSATIONS = [
    *[(1, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 9)) for i in range(700)],
    (2, 0, "system", "be kind"), *[(2, i, "user" if i % 2 else "assistant", "word " * 40) for i in range(1, 60)],
    (3, 0, "system", "alone"), (4, None, "user", "null turn"), (4, 1, None, None), (4, 1, "tool", "x"), (4, 1, "tool", "x"), (4, -3, "assistant", "before"),
    (None, 0, "user", "no conversation"), (None, 1, "assistant", ""), (5, 0, "assistant", "long " * 3000), (5, 1, "assistant", "short"),
    (6, 0, "system", "long rules " * 400), (6, 1, "user", "hi"), (6, 2, "assistant", "ho"),
]


def plain_conversations(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, (r[2] or "").encode(), (r[3] or "").encode()))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        found[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return found


@pytest.mark.parametrize("budget, history, cell", [(2048, 512, 16384), (200, 60, 400), (50, 0, 50)])
def test_windows(spark, budget, history, cell):
    table = spark.createDataFrame([(*r, 1, "x") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, cell int, block string").repartition(4)
    windows = chat.format_windows(table, budget=budget, history=history, cell=cell).cache()
    read = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_conversations(windows).collect()}
    assert read == plain_conversations(CONVERSATIONS)
    for w in windows.collect():
        turns = chat.read_turns(w["formatted"])
        assert len(turns) == w["turns"] and len(turns) - w["repeated"] >= 1
        assert w["over_budget"] == (w["tokens"] > budget)
        if w["over_budget"]:  # only what can't be cut: the system turn and one turn
            assert len(turns) - (turns[0][0] == "system") <= 1 or turns[0][0] != "system" and len(turns) == 1
        if w["conv_id"] in (2, 6):
            assert turns[0][0] == "system"
    assert windows.where("conv_id = 1").count() > 1


def test_history_is_repeated_and_masked(spark):
    rows = [(1, 0, "system", "s"), *[(1, i, "user" if i % 2 else "assistant", f"t{i} " * 20) for i in range(1, 40)]]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=120, history=50, cell=240).orderBy("first_token").collect()
    assert all(w["repeated"] >= 2 for w in windows[1:]) and windows[0]["repeated"] == 0
    for w in windows:
        turns = chat.read_turns(w["formatted"])
        new = [t for role, t in turns[w["repeated"] :] if role == "assistant"]
        assert [w["formatted"][s["start"] : s["end"]] for s in w["spans"]] == new


def test_chat_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    planted = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", planted), (-7, 1, "assistant", planted)]
    found = {r["conv_id"]: tuple(r)[1:5] for r in queries()["op10_budgeted_chat_windows"](spark, small).collect()}
    assert found == plain_conversations(rows)
    assert chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- pipeline


def five_word_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_like_its_parts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in queries()["op2_rule_ledger"](spark, small).where("kept").collect()}
    left = {k: t for k, t in left.items() if k in good}
    filtered = docs.where(F.col("doc_id").isin(sorted(left)))
    scorer = weaklabels.fit(filtered, spark.read.parquet(f"{small}/labels.parquet"))
    left = {k: t for k, t in left.items() if max(scorer.score(t or "")) < 0.5}
    sets = {k: five_word_set(t) for k, t in left.items()}
    root = {k: k for k in left}
    changed = True
    while changed:
        changed = False
        for a in left:
            for b in left:
                alike = sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
                if alike and root[a] < root[b]:
                    root[b], changed = root[a], True
    kept = {k for k in left if root[k] == k}
    found = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in found} == kept and len(kept) > 20
    assert len({r["sequence_id"] for r in found}) < len(found)


def test_stages_take_odd_rows(spark, small):
    given = spark.read.parquet(f"{small}/documents.parquet").limit(0).withColumn("extra", F.lit("e"))
    odd = spark.createDataFrame([(None, None, None, None, None, "e"), (1, "", "en", "s", 0, "e"), (2, "the same ten words are in here two times over again", "en", "s", 1, "e"), (3, "the same ten words are in here two times over again", "en", "s", 1, "e"), (3, "the same ten words are in here two times over again", "en", "s", 1, "e")], given.schema)
    for docs, rows in ((given, 0), (odd, 1)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small)
            if name != "packing":
                assert docs.columns == given.columns
        assert docs.select("doc_id").distinct().count() == rows


# --- manifest


def plain_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> list of (doc_id, leaf, subroot, root, proof, folded, verified)."""

    def h(data):
        return hashlib.sha256(data.encode()).hexdigest()

    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def bent(row):
        odd = row[0] is None or zlib.crc32(str(row[0]).encode()) % 2
        return row if odd or row[4] is None else (*row[:4], row[4].replace("\n", ""))

    def build(nodes):
        """Levels of a tree, from the leaves to the one node left."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def rise(levels, place, own):
        met = ""
        for level in levels[:-1]:
            run = level[place // 3 * 3 : place // 3 * 3 + 3]
            before, after = "".join(run[: place % 3]), "".join(run[place % 3 + 1 :])
            met, own, place = met + before + after, h(before + own + after), place // 3
        return met, own

    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    sources = list(dict.fromkeys(r[1] for r in order))
    groups = {s: [r for r in order if r[1] == s] for s in sources}
    lower = {s: build([leaf(r) for r in groups[s]]) for s in sources}
    upper = build([lower[s][-1][0] for s in sources])
    found = []
    for at, s in enumerate(sources):
        for place, r in enumerate(groups[s]):
            one, own = rise(lower[s], place, leaf(bent(r)))
            two, own = rise(upper, at, own)
            found.append((r[0], leaf(r), lower[s][-1][0], upper[-1][0], h(one + two), own, own == upper[-1][0]))
    return found


def manifest_rows(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars int, text string, digest int, key string").repartition(3)
    text = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return [(r["key"], *(r[c].hex() for c in ("leaf", "subroot", "root", "proof", "folded")), r["verified"]) for r in merkle.manifest(docs, {"text": text}).collect()]


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [1, 1], [9, 1, 10], [28, 3, 1, 1, 5, 2, 40, 1, 1, 1, 2]])
def test_manifest_of_trees_of_all_shapes(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "BLOCK", 4)  # many blocks: the upper nodes are repeated
    monkeypatch.setattr(merkle, "CLIMB", merkle.CLIMB.replace("DIV 8192", "DIV 4"))
    rows = [(100 * s + i, f"source{s}", "en", i, f"text {i}\nof {s}") for s, n in enumerate(sizes) for i in range(n)]
    assert sorted(manifest_rows(spark, rows)) == sorted(plain_manifest(rows))


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "de", 3, "a\nb"), (2, "é", "en", 1, ""), (2, "é", "en", 1, ""), (2, "é", "fr", 1, "\n" * 5), (3, "z", "en", 0, "x" * 100_000 + "\n"), (-4, "z", None, None, None)]
    assert sorted(manifest_rows(spark, rows), key=str) == sorted(plain_manifest(rows), key=str)
    assert manifest_rows(spark, []) == []
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    assert merkle.manifest(docs).where("verified").count() == len(rows)  # nothing tampered with


def test_manifest_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, queries()["op12_recursive_manifest"](spark, small).collect())) == sorted(plain_manifest(rows))
