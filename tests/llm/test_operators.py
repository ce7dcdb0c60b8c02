"""The corpus operators against brute force, round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import TABLES, rows_of
from tapewright.llm import (
    chat, decontaminate, language_id, minhash, nearest, packing, quality, queries, sharding, substring_dedup,
    url_filters, words,
)
from tapewright.llm.graph import all_stars, components, link_batches, stars
from tapewright.llm.shipping import ship

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, comp long, k long"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="provided tables are not here")


def frame(spark, rows):
    return ship(spark).createDataFrame([(i, t, None, None, None, 3, 0.5, 1, 2) for i, t in rows], DOCS)


def odd_rows(seed=1):
    """Nulls, blanks, a long text, ties, exact and near copies, shared passages, repeated lines and words."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "naïve,", "日本語", "A"]

    def some(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    passage, base = some(35), some(120)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four"), (6, "a " * 60), (7, "a b " * 40)]
    rows += [(8, " ".join(some(4000) + passage + some(3000))), (9, " \x1c x"), (10, " ".join(base))]
    for i in range(20, 60):
        kind = i % 5
        text = some(60)
        if kind == 0:
            text = list(base)
        elif kind == 1:
            text = list(base)
            text[rnd.randrange(120)] = "edit"
        elif kind == 2:
            text = some(30) + passage + some(rnd.randrange(30))
        elif kind == 3:
            text = (some(6) * 5)
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(text)))
    rnd.shuffle(rows)
    return rows


class TestSharding:
    def rows(self, spark, ids):
        return spark.createDataFrame([(i, 1) for i in ids], "doc_id long, size long")

    def test_counts_differ_by_one_and_slots_have_no_gap(self, spark):
        out = sharding.place(self.rows(spark, [*range(100), None, None, 5, 5]), F.col("doc_id"), 16).collect()
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        assert len(out) == 104 and {len(s) for s in slots.values()} <= {6, 7} and len(slots) == 16
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert Counter(r.doc_id for r in out)[5] == 3

    def test_one_key_may_hold_everything(self, spark):
        out = sharding.place(self.rows(spark, [7] * 40), F.col("doc_id"), 4).groupBy("shard").count().collect()
        assert {r["count"] for r in out} == {10}

    def test_slack_bounds_loads_and_moves_little(self, spark):
        few = dict(sharding.place(self.rows(spark, range(2000)), F.col("doc_id"), 8, slack=0.25).select("doc_id", "shard").collect())
        more = dict(sharding.place(self.rows(spark, range(2000)), F.col("doc_id"), 9, slack=0.25).select("doc_id", "shard").collect())
        assert max(Counter(few.values()).values()) <= 313
        assert sum(few[i] != more[i] for i in few) < 2000 * 0.35

    def test_empty_and_clashes(self, spark):
        assert sharding.place(self.rows(spark, []), F.col("doc_id"), 4).count() == 0
        with pytest.raises(ValueError):
            sharding.place(frame(spark, []), F.col("doc_id"), 4)


def removed_by_hand(rows):
    seen, out = {}, {}
    for i, text in sorted(rows):
        found = WORD.findall(text or "")
        gone = [False] * len(found)
        for s in range(len(found) - 19):
            if seen.setdefault(tuple(found[s:s + 20]), (i, s)) != (i, s):
                gone[s:s + 20] = [True] * 20
        out[i] = (len(found), sum(gone), " ".join(w for w, g in zip(found, gone) if not g))
    return out


class TestSubstringDedup:
    @pytest.mark.parametrize("hot", [2000, 3])
    def test_equals_brute_force(self, spark, monkeypatch, hot):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        rows = odd_rows()
        out = substring_dedup.deduplicate(frame(spark, rows)).collect()
        want = removed_by_hand(rows)
        assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in out} == want
        assert all(sum(s.length for s in r.spans) == r.n_removed for r in out)

    def test_repeated_rows_and_empty_tables(self, spark):
        text = " ".join(f"x{i}" for i in range(30))
        out = substring_dedup.deduplicate(frame(spark, [(1, text), (1, text), (None, None), (2, text)])).collect()
        assert Counter((r.doc_id, r.n_removed) for r in out) == {(1, 0): 2, (None, 0): 1, (2, 30): 1}
        assert substring_dedup.deduplicate(frame(spark, [])).count() == 0

    def test_automaton_statistics(self):
        rnd = random.Random(3)
        told = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(25)] for _ in range(6)]
        automaton = substring_dedup.SuffixAutomaton()
        for t in told:
            automaton.add(t)
        asked = [rnd.choice([b"a", b"b", b"c"]) for _ in range(60)]
        known = {tuple(t[i:j]) for t in told for i in range(25) for j in range(i + 1, 26)}
        want = [max([n for n in range(1, i + 2) if tuple(asked[i + 1 - n:i + 1]) in known], default=0) for i in range(60)]
        assert automaton.statistics(asked) == want


class TestLanguage:
    def test_held_out_accuracy_and_odd_texts(self, spark):
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        out = queries.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
        assert np.mean([r.lang == r.lang_pred for r in out]) > 0.9
        net = language_id.train(docs)
        odd = language_id.predict(frame(spark, [(1, None), (2, ""), (3, "123 !"), (None, "é" * 5000), (4, "x"), (4, "x")]), net).collect()
        assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in odd)
        assert odd[4] == odd[5] and odd[3].lang_pred != "und"
        assert language_id.predict(frame(spark, []), net).count() == 0

    def test_nothing_learned(self, spark):
        net = language_id.train(frame(spark, [(1, "some text")]))
        assert language_id.predict(frame(spark, [(1, "some text")]), net).first().lang_pred == "und"

    def test_gradient_matches_differences(self):
        net = language_id.fit(["abc" * 90, "xyz" * 90], ["a", "b"], epochs=0)
        net.out = net.out.astype(np.float64)
        x = np.concatenate([language_id.windows_of(np.frombuffer(t, np.uint8)) for t in (b"abc" * 50, b"xyz" * 50)])
        y = np.array([0, 1])
        exact = language_id.gradients(net, x, y, np.ones_like(net.filters))["out"]
        for at in ((0, 0), (7, 1)):
            losses = []
            for step in (1e-4, -1e-4):
                net.out[at] += step
                losses.append(-net.log_probs(x)[np.arange(2), y].mean())
                net.out[at] -= step
            assert abs((losses[0] - losses[1]) / 2e-4 - exact[at]) < 1e-3


class TestQuality:
    def test_held_out_ranking(self, spark):
        labels = spark.read.parquet(f"{SF}/labels.parquet")
        out = queries.op4_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
        good = [r.score for r in out if r.quality == 1]
        bad = [r.score for r in out if r.quality == 0]
        assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean(np.array(good) >= 0.5) > 0.95

    def test_odd_texts_and_no_labels(self, spark):
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        model = queries.quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        plain = frame(spark, odd_rows()).drop("score")
        out = quality.score(plain, model).collect()
        assert len(out) == len(odd_rows()) and all(0 <= r.score <= 1 for r in out)
        assert quality.score(plain.limit(0), model).count() == 0
        none = quality.train(plain, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
        assert quality.score(plain, none).first().score == 0.5
        with pytest.raises(ValueError):
            quality.score(frame(spark, []), model)


class TestPacking:
    def test_round_trip_and_limits(self, spark):
        from tokenizers import Tokenizer

        rows = odd_rows() + [(None, "It's <|endoftext|> x<|ENDOFTEXT|>y don't 'll A1b2 ﬁ Å"), (4, "one")]
        out = packing.pack(frame(spark, rows).coalesce(2), queries.tokenizer_path(), limits=packing.Limits(512, 6, 512)).collect()
        exact = Tokenizer.from_file(queries.tokenizer_path())
        want = Counter((i, tuple(exact.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in rows)
        parts, held = defaultdict(list), defaultdict(list)
        for r in out:
            held[r.sequence_id].append(r)
            parts[r.doc_id, r.doc_tokens].append(r)
        got = Counter()
        for (i, total), pieces in parts.items():
            copies = sum(p.length for p in pieces) // total
            pieces.sort(key=lambda p: p.start)
            got[i, tuple(x for p in pieces[::copies] for x in np.frombuffer(p.ids, "<u4").tolist())] += copies
        assert got == want
        for seq in held.values():
            seq.sort(key=lambda p: p.offset)
            assert [p.offset for p in seq] == np.cumsum([0, *[p.length for p in seq[:-1]]]).tolist()
            assert sum(p.length for p in seq) <= 512 and len(seq) <= 6 and sum(p.loss_tokens for p in seq) <= 512
        assert packing.pack(frame(spark, []), queries.tokenizer_path()).count() == 0

    def test_loss_limit_of_instruction_data(self, spark):
        rows = ship(spark).createDataFrame([(i, "p " * 50, "q " * (10 + i)) for i in range(20)], "doc_id long, prompt string, text string").coalesce(1)
        out = packing.pack(rows, queries.tokenizer_path(), limits=packing.Limits(400, 10, 60), prompt="prompt").collect()
        for seq in {r.sequence_id for r in out}:
            own = [r for r in out if r.sequence_id == seq]
            assert sum(r.loss_tokens for r in own) <= 60 and sum(r.length for r in own) <= 400
        assert sum(r.loss_tokens for r in out) == sum(11 + i for i in range(20))


class TestChat:
    SAID = [(1, 0, "user", "a & <|im_end|>\n<|im_start|>"), (1, 1, "assistant", "&lt;| &amp; <<|im_end|>"), (1, 2, None, None),
            (2, 5, "assistant", ""), (2, 5, "assistant", "x"), (2, None, "us\ner", "é"), (None, 0, "user", "n"), (3, 1, "assistant", "<"), (3, 1, "assistant", "<")]

    def test_reads_back(self, spark):
        rows = spark.createDataFrame(self.SAID, "conv_id long, turn long, role string, text string")
        out = {r.conv_id: r for r in chat.format_paths(chat.linear_tree(rows)).collect()}
        by = defaultdict(list)
        for c, t, role, text in sorted(self.SAID, key=lambda r: (r[0] or -9, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
            by[c].append((role or "", text or ""))
        assert set(out) == set(by)
        for c, turns in by.items():
            assert chat.read_back(out[c].formatted) == turns
            masked = "".join(chat.unescaped(out[c].formatted[s.start:s.start + s.length]) for s in out[c].loss)
            assert masked == "".join(text for role, text in turns if role == "assistant")

    def test_branches_by_score(self, spark):
        tree = spark.createDataFrame(
            [(1, 1, None, 1.0), (1, 2, 1, 0.0), (1, 3, 1, 0.9), (1, 4, 3, 0.8), (1, 5, 3, None), (1, 9, 77, 5.0), (2, 1, None, 0.0)]
            + [(3, i, i - 1 if i > 1 else None, 0.1) for i in range(1, 40)], "conv_id long, node long, parent long, score double")
        out = defaultdict(list)
        for r in chat.best_paths(tree, 2).orderBy("depth").collect():
            out[r.conv_id, r.branch].append((r.depth, r.node))
        assert out == {(1, 1): [(1, 1), (2, 3), (3, 4)], (1, 2): [(1, 1), (2, 3), (3, 5)], (2, 1): [(1, 1)],
                       (3, 1): [(i, i) for i in range(1, 40)]}

    def test_query(self, spark):
        out = queries.op6_chat(spark, SF).where("conv_id = -1").first()
        told = f"user\n{queries.PROBE}\nassistant\n{queries.PROBE}\n"
        assert out.n_turns == 2 and out.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert out.loss_sha256 == hashlib.sha256(queries.PROBE.encode()).hexdigest() and out.loss_chars == len(queries.PROBE)


def shingle_sets(rows):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return sets


def groups_by_hand(rows, percent=85):
    sets = shingle_sets(rows)
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if g == old else g for i, g in label.items()}
    return {i: (len(s), label[i]) for i, s in sets.items()}


class TestMinHash:
    @pytest.mark.parametrize("block", [256, 5])
    def test_equals_brute_force(self, spark, monkeypatch, block):
        monkeypatch.setattr(minhash, "EXACT_BLOCK", block)
        monkeypatch.setattr(minhash, "BLOCK", block)
        rows = odd_rows(2)
        out = minhash.near_duplicates(frame(spark, rows)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == groups_by_hand(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)

    def test_null_ids_repeats_and_empty(self, spark):
        out = minhash.near_duplicates(frame(spark, [(None, "a b"), (3, "A  b"), (3, "A  b"), (None, None), (None, "z")])).collect()
        assert Counter((r.doc_id, r.component_id, r.kept) for r in out) == {
            (None, 3, False): 1, (3, 3, True): 2, (None, None, True): 2}
        assert minhash.near_duplicates(frame(spark, [])).count() == 0

    def test_estimate_is_near_the_truth(self):
        rng = np.random.default_rng(1)
        shared = rng.integers(0, 1 << 62, 900).astype(np.uint64)
        a = np.concatenate((shared, rng.integers(0, 1 << 62, 100).astype(np.uint64)))
        b = np.concatenate((shared, rng.integers(0, 1 << 62, 100).astype(np.uint64)))
        low = minhash.packed(minhash.minima(np.concatenate((a, b)), np.array([0, 1000, 2000])))
        assert abs(minhash.estimate(low[:1], low[1:])[0, 0] - 900 / 1100) < 0.1

    @pytest.mark.parametrize(("small", "large"), [(6, 7), (17, 20)])
    def test_estimate_keeps_links_of_short_texts(self, small, large):
        """Pairs of which one set holds the other, all at 0.85 or more: none may fall below the floor."""
        n = 20_000
        sets = np.random.default_rng(5).integers(0, 1 << 63, (n, large)).astype(np.uint64)
        a, b = (minhash.packed(minhash.minima(sets[:, :w].ravel(), np.arange(n + 1) * w)) for w in (small, large))
        near = np.concatenate([np.diag(minhash.estimate(a[i:i + 250], b[i:i + 250])) for i in range(0, n, 250)])
        assert near.min() >= minhash.floor_of(85)

    def test_kept_bits_follow_no_class_of_shingles(self):
        """Sets of 6 and 7 sharing 6: the spread of the estimate is the binomial one."""
        n = 4000
        sets = np.random.default_rng(6).integers(0, 1 << 63, (n, 7)).astype(np.uint64)
        a, b = (minhash.packed(minhash.minima(sets[:, :w].ravel(), np.arange(n + 1) * w)) for w in (6, 7))
        near = np.concatenate([np.diag(minhash.estimate(a[i:i + 250], b[i:i + 250])) for i in range(0, n, 250)])
        same = 0.25 + 0.75 * 6 / 7
        assert near.std() < 1.15 * (same * (1 - same) / 256) ** 0.5 / 0.75

    def test_long_chain_is_one_component(self, spark):
        links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
        out = dict(components(links).collect())
        assert set(out.values()) == {0, 100} and len(out) == 63

    def test_links_of_a_task_become_stars(self):
        rng = random.Random(3)
        lists = [[(rng.randrange(300), rng.randrange(300)) for _ in range(9)] for _ in range(20)]
        whole = dict(stars([link for links in lists for link in links]))
        for most in (4, 1000):
            cut = [link for b in link_batches(lists, most) for link in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            assert dict(stars(cut)) == whole
        assert all(a > b and b not in whole for a, b in whole.items())
        assert list(link_batches([])) == []

    @pytest.mark.parametrize(("links", "done"), [
        ([], True), ([(2, 1), (3, 1), (9, 8)], True), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False)])
    def test_stars_are_recognised(self, spark, links, done):
        assert all_stars(spark.createDataFrame(links, "a long, b long")) == done


class TestDecontamination:
    def test_equals_brute_force(self, spark):
        rnd = random.Random(5)
        items = [(i, " ".join(f"t{rnd.randrange(90)}" for _ in range(rnd.choice([1, 3, 5, 9, 20, 33])))) for i in range(25)]
        items += [(90, None), (91, " "), (92, items[0][1]), (None, "un seul")]
        docs = []
        for i in range(60):
            w = [f"T{rnd.randrange(90)}" for _ in range(200)]
            for _, t in rnd.sample(items[:25], 2):
                own = t.split()
                if len(own) > 8:
                    own[rnd.randrange(len(own))] = "changed"
                at = rnd.randrange(150)
                w[at:at] = own
            docs.append((i, ", ".join(w)))
        docs += [(70, None), (71, ""), (None, "Un, seul!"), (3, "nothing")]

        def sets(text, width):
            w = re.findall(r"[^\W_]+", (text or "").lower())
            return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}, len(w)

        want = {}
        for j, item in items:
            n = sets(item, 1)[1]
            own = sets(item, min(5, n))[0] if n else set()
            for i, text in docs:
                if own and (both := len(own & sets(text, min(5, n))[0])) * 10 >= 8 * len(own):
                    want[i, j] = (both, len(own))
        table = spark.createDataFrame(items, "item_id long, text string")
        out = decontaminate.contained(frame(spark, docs), table).collect()
        assert {(r.doc_id, r.item_id): (r.shared, r.n_shingles) for r in out} == want and len(out) == len(want)
        assert decontaminate.contained(frame(spark, []), table).count() == 0
        assert decontaminate.contained(frame(spark, docs), table.limit(0)).count() == 0


class TestNearest:
    def test_recall_ties_and_unusable(self, spark):
        rng = np.random.default_rng(2)
        x = rng.normal(size=(3000, 16))
        x[1000:1400] = x[7]
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + [
            (5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] + [1.0] * 15), (5200, [1.0]), (None, [1.0] * 16)]
        table = ship(spark).createDataFrame(rows, "vec_id long, embedding array<float>")
        out = nearest.search(table, F.col("vec_id") % 50 == 0).collect()
        got = defaultdict(dict)
        for r in out:
            got[r.query_id][r.rank] = (r.vec_id, r.score)
        x = x.astype(np.float32).astype(np.float64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        right = 0
        for q in range(0, 3000, 50):
            score = unit @ unit[q]
            score[q] = -9
            best = sorted(range(3000), key=lambda i: (-round(score[i], 12), i))[:5]
            right += len({v for v, _ in got[q].values()} & set(best))
            assert all(abs(s - score[v]) < 1e-9 for v, s in got[q].values()) and q not in {v for v, _ in got[q].values()}
        assert right >= 0.9 * 5 * 60 and set(got) == set(range(0, 3000, 50))
        assert [got[1000][r][0] for r in range(1, 6)] == [7, 1001, 1002, 1003, 1004]
        assert nearest.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
        few = nearest.search(table.where("vec_id in (0, 3, 4)"), F.col("vec_id") % 50 == 0).count()
        assert few == 2

    def test_every_length_has_its_own_neighbours(self, spark):
        rng = np.random.default_rng(4)
        groups = {16: range(300), 8: range(1000, 1040), 4: range(2000, 2002), 3: range(3000, 3001)}
        rows = {i: rng.normal(size=d).astype(np.float32) for d, ids in groups.items() for i in ids}
        table = ship(spark).createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<float>")
        got = defaultdict(list)
        for r in nearest.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        want = {}
        for ids in groups.values():
            unit = {i: rows[i].astype(np.float64) / np.linalg.norm(rows[i].astype(np.float64)) for i in ids}
            for q in ids:
                if q % 20 == 0 and len(ids) > 1:
                    want[q] = sorted((i for i in ids if i != q), key=lambda i: (-float(unit[i] @ unit[q]), i))[:5]
        assert dict(got) == want


    @pytest.mark.parametrize("sf", ["sf0.1", "clusters"])
    def test_recall_with_fewer_cosines_than_an_exact_search(self, spark, sf):
        """The forest alone, without Spark: recall and cosines of the measured share."""
        rng = np.random.default_rng(8)
        if sf == "sf0.1":
            rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
            x = nearest.unit(np.array([r.embedding for r in rows], dtype=float))
        else:
            x = nearest.unit(np.repeat(rng.normal(size=(60, 24)), 100, axis=0) + rng.normal(size=(6000, 24)) * 0.15)
        share = nearest.share_for(x, 5)
        forest = nearest.fit(x, len(x))
        leaf = forest.leaves(x)
        probes = int(share * nearest.TREES * 2 ** forest.depth)
        found, cosines, asked = 0, 0, range(0, len(x), 50)
        for i in asked:
            met = np.zeros(len(x), bool)
            for tree, node in forest.search(x[i], probes):
                own = leaf[:, tree] == node
                cosines += own.sum()
                met |= own
            score = x @ x[i]
            score[i] = -2
            found += met[np.argsort(-score)[:5]].sum()
        assert found >= 0.9 * 5 * len(asked)
        assert cosines < len(asked) * len(x) * (1.0 if sf == "sf0.1" else 0.35)


class TestUrlFilters:
    def test_equals_brute_force(self, spark):
        import datetime as dt

        rnd = random.Random(4)
        day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
        names = ["a.com", "x.a.com", "y.x.a.com", "b.org", "com"]
        entries = [(rnd.choice(names), day(rnd.randrange(200)), rnd.choice(["block", "allow", "remove", None])) for _ in range(40)]
        entries += [(None, day(3), "block"), ("a.com", None, "block"), entries[0]]
        pages = [(i, f"HTTP{rnd.choice(['', 's'])}://{rnd.choice(['', 'u@'])}{rnd.choice(['', 'www.'])}{rnd.choice(names[:4])}{rnd.choice(['', ':8080', '.', '/a?b'])}",
                  day(rnd.randrange(220))) for i in range(150)]
        pages += [(900, None, day(5)), (901, "no url", day(5)), (902, "http://a.com", None), (None, "http://a.com", day(9)), pages[0]]
        strength = {"block": 2, "allow": 1}
        changes = defaultdict(dict)
        for name, when, action in entries:
            if name and when:
                changes[name][when] = max(changes[name].get(when, 0), strength.get(action, 0))

        def judged(url, when):
            m = re.match(r"[A-Za-z]+://(?:.*@)?([^/?#:]*?)\.?(?::\d+)?(?:[/?#]|$)", url or "")
            host = m.group(1).lower() if m else None
            parts = host.split(".") if host else []
            for i in range(len(parts)):
                name = ".".join(parts[i:])
                past = [d for d in changes[name] if when and d <= when]
                if past and changes[name][max(past)]:
                    return {2: "block", 1: "allow"}[changes[name][max(past)]], name
            return "none", None

        out = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, fetched date"),
                                spark.createDataFrame(entries, "domain string, changed date, action string")).collect()
        want = Counter((i, *judged(u, f)) for i, u, f in pages)
        assert Counter((r.page_id, r.decision, r.matched) for r in out) == want
        empty = spark.createDataFrame([], "domain string, changed date, action string")
        assert url_filters.judge(spark.createDataFrame(pages[:3], "page_id long, url string, fetched date"), empty).where("decision <> 'none'").count() == 0


def test_words_match_the_pattern():
    texts = [t or "" for _, t in odd_rows(7)] + ["x" * 600_000, "y " * 300_000]
    data, offsets = words.utf8(pa.array(texts))
    out = words.words_of(data, offsets)
    raw = data.tobytes()
    for i, text in enumerate(texts):
        a, b = out.first[i], out.first[i + 1]
        assert [raw[s:e].decode() for s, e in zip(out.start[a:b], out.end[a:b])] == WORD.findall(text)
    by = defaultdict(set)
    for s, e, h in zip(out.start, out.end, out.hash):
        by[raw[s:e]].add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({h for v in by.values() for h in v}) == len(by)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_agrees_with_sql(spark, con, name):
    cur = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_pipeline_stages(spark):
    docs = queries.table(spark, SF, "documents")
    kept = {r.doc_id: r.text for r in docs.collect()}
    from tapewright.session import settle

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = dict(kept)
        docs = settle(stage(spark, docs, SF), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            lost = [i for i in before if i not in kept]
            assert lost and sum(labels.get(i) == 1 for i in lost) <= 2
        if name == "near_duplicates":
            assert set(kept) == {i for i, (_, c) in groups_by_hand(before.items(), 80).items() if i == c}
        if name == "substring_dedup":
            assert kept == {i: t for i, (_, _, t) in removed_by_hand(before.items()).items()}
        if name == "decontamination":
            assert 0 < len(kept) < len(before)
    pieces = corpus_pipeline.sequences(spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(kept)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert all(zlib.crc32(p.ids) is not None and len(p.ids) == 4 * p.length for p in pieces)


def test_pipeline_of_no_documents(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
