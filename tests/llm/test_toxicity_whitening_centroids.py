"""Toxicity, whitening and centroid clustering against brute force and held-out labels; rows of odd ids in the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapewright.llm import centroids, queries, toxicity, whitening
from tapewright.llm.shipping import ship
from tapewright.llm.words import utf8, words_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="provided tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, extra string"


def documents(spark, rows):
    return ship(spark).createDataFrame([(i, t, "en", "web", len(t or ""), 3, "x") for i, t in rows], DOCS)


def vectors(spark, rows):
    return ship(spark).createDataFrame([(i, v, 7, 0.5) for i, v in rows], "vec_id long, embedding array<float>, component int, distance double")


class TestToxicity:
    def corpus(self, n=400):
        rnd = random.Random(3)
        clean = [f"plain{i}" for i in range(300)]
        foul = ["vileword", "foulness", "grimmer", "nastyone"]
        texts, marks = [], []
        for i in range(n):
            words = [rnd.choice(clean) for _ in range(rnd.randrange(20, 200))]
            toxic = i % 6 == 0
            if toxic:
                for _ in range(max(2, len(words) // 20)):
                    words[rnd.randrange(len(words))] = rnd.choice(foul)
            texts.append(" ".join(words))
            marks.append(int(toxic))
        return texts, marks

    def test_learns_from_positives_and_unlabelled_texts(self, spark):
        texts, marks = self.corpus()
        docs = documents(spark, enumerate(texts))
        labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks) if i < 300], "doc_id long, toxic int")
        model = toxicity.train(docs.where("doc_id < 300"), labels)
        out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
        held = range(300, 400)
        assert all((out[i] >= 0.5) == bool(marks[i]) for i in held)

    def test_scores_are_the_dot_product_of_shares(self):
        texts, marks = self.corpus(60)
        words = words_of(*utf8(pa.array(texts)), lower=True, cut=True)
        rows = toxicity.terms_of(words)
        model = toxicity.fit(rows.take(np.flatnonzero(marks)), rows, 0.2, epochs=3)
        z = [float((rows.value[a:b] * model.weight.mean(axis=0)[rows.term[a:b]]).sum()) + model.bias.mean()
             for a, b in zip(rows.first[:-1], rows.first[1:], strict=True)]
        assert np.allclose(model.scores(words), [1 / (1 + math.exp(-v)) for v in z], atol=1e-4)

    def test_terms_by_hand(self):
        words = words_of(*utf8(pa.array(["Idiotic idio idiots", None, "ab"])), lower=True, cut=True)
        rows = toxicity.terms_of(words)
        share = sorted(rows.value[rows.first[0]:rows.first[1]].round(3).tolist())
        # three words; beginnings: idio 3, idiot 2, idioti 1, idiots 1; the whole words once each
        assert share == pytest.approx(sorted([100 / 3] * 5 + [200 / 3, 100.0]), abs=1e-2)
        assert rows.first.tolist() == [0, 7, 7, 8]

    @pytest.mark.parametrize("clean", [True, False])
    def test_gradient_matches_differences(self, clean):
        rng = np.random.default_rng(1)
        z_p, z_u = rng.normal(size=5) + (0 if clean else 3), rng.normal(size=9) + (0 if clean else -3)
        prior = 0.3 if clean else 0.9

        def loss(z):
            return (1 / (1 + np.exp(z))).mean()

        def risk(p, u):
            second = loss(-u) - prior * loss(-p)
            return prior * loss(p) + second if second >= 0 else -second

        on_p, on_u = toxicity.gradient(z_p, z_u, prior)
        assert (loss(-z_u) - prior * loss(-z_p) >= 0) == clean
        for at in range(5):
            step = np.eye(5)[at] * 1e-6
            assert on_p[at] == pytest.approx((risk(z_p + step, z_u) - risk(z_p - step, z_u)) / 2e-6, abs=1e-6)
        for at in range(9):
            step = np.eye(9)[at] * 1e-6
            assert on_u[at] == pytest.approx((risk(z_p, z_u + step) - risk(z_p, z_u - step)) / 2e-6, abs=1e-6)

    def test_no_language_is_given_up(self):
        """Four vocabularies with foul words of their own, a fiftieth of the words of a toxic text; they are not as frequent among toxic texts as elsewhere."""
        rng = np.random.default_rng(11)
        among = {True: [0.5, 0.2, 0.18, 0.12], False: [0.65, 0.15, 0.12, 0.08]}
        # A fifth of the words are the commonest few, whose shares are large.
        plain = [[f"{a}{i:03d}" for i in range(400)] for a in ("wort", "mots", "word", "pala")]
        foul = [[f"{a}{i}" for i in range(6)] for a in ("übel", "vilain", "scorn", "torpe")]

        def text(lang, toxic):
            n = int(rng.integers(80, 400))
            at = np.where(rng.random(n) < 0.2, rng.integers(0, 4, n), rng.integers(0, 400, n))
            words = [plain[lang][i] for i in at]
            for j in rng.choice(n, max(2, n // 50), replace=False) if toxic else ():
                words[j] = foul[lang][rng.integers(6)]
            return " ".join(words)

        def rows(n, toxic):
            bad = rng.random(n) < toxic
            lang = np.array([rng.choice(4, p=among[bool(b)]) for b in bad])
            texts = pa.array([text(a, b) for a, b in zip(lang, bad, strict=True)])
            return lang, bad, words_of(*utf8(texts), lower=True, cut=True)

        model = toxicity.fit(toxicity.terms_of(rows(1500, 1)[2]), toxicity.terms_of(rows(3000, 0.1)[2]), 0.1)
        lang, bad, words = rows(1200, 0.4)
        hit = model.scores(words) >= 0.5
        for at in range(4):
            assert hit[bad & (lang == at)].mean() > 0.9, at
        assert hit[~bad].mean() < 0.01

    def test_without_telling_terms_nothing_is_found(self):
        words = words_of(*utf8(pa.array(["one two three", "three two one", "two"] * 20)), lower=True, cut=True)
        rows = toxicity.terms_of(words)
        assert toxicity.fit(rows, rows, 0.1).scores(words).max() < 0.5

    def test_odd_rows(self, spark):
        texts, marks = self.corpus(120)
        docs = documents(spark, [*enumerate(texts), (None, texts[0]), (500, None), (501, ""), (502, " \n"), (503, "vileword " * 30_000), (0, texts[0])])
        labels = spark.createDataFrame([*enumerate(marks), (None, 1), (500, 1), (7, None), (3, 9)], "doc_id long, toxic int")
        model = toxicity.train(docs, labels)
        out = toxicity.score(docs, model).collect()
        by = defaultdict(set)
        for r in out:
            by[r.doc_id].add(r.score)
        assert len(out) == 126 and all(0 <= r.score <= 1 for r in out) and "extra" in toxicity.score(docs, model).columns
        assert len(by[0]) == 1 and by[0] == by[None] and by[500] == by[501] == by[502] and min(by[503]) >= 0.5 > max(by[500])
        assert toxicity.score(docs.limit(0), model).count() == 0
        none = toxicity.train(docs, labels.where("toxic = 0"))
        assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
        assert {r.score for r in toxicity.score(docs, toxicity.train(docs.limit(0), labels)).collect()} == {0.0}
        with pytest.raises(ValueError):
            toxicity.score(docs.withColumn("score", F.lit(1)), model)

    def test_query_on_held_out_labels(self, spark):
        sf = "/root/testdata/sf0.1"
        out = queries.op11_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
        bad = [r.predicted for r in out if r.toxic == 1]
        good = [r.predicted for r in out if r.toxic == 0]
        assert np.mean(bad) > 0.9 and np.mean(good) < 0.005
        assert all(r.predicted == (r.score >= 0.5) for r in out)


def integers(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


class TestWhitening:
    def by_hand(self, rows):
        """Distinct integer vectors, their covariance by numpy, and the eigenvectors of a plain double decomposition."""
        x = np.array(sorted({tuple(integers(v)) for _, v in rows}), dtype=np.int64)
        n, total = len(x), x.sum(axis=0)
        centred = x - total / n
        value, vector = np.linalg.eigh(centred.T @ centred / n)
        return n, total, value[::-1], vector[:, ::-1]

    def test_equals_numpy(self, spark):
        rng = np.random.default_rng(1)
        base = rng.normal(size=(300, 16)) * np.linspace(0.3, 2, 16)
        rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[5].tolist()) for i in range(100)]
        odd = [(None, base[7].tolist()), (2000, None), (2001, [None] + [1.0] * 15), (2002, [float("nan")] * 16), (2003, [float("inf")] + [0.0] * 15), (2004, [])]
        out = whitening.whiten(vectors(spark, rows + odd)).collect()
        n, total, value, vector = self.by_hand(rows)
        by = {(r.vec_id, r.component): r for r in out}
        assert len(out) == 4 * 401 and len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9
        sign = {}
        for i, v in [*rows, (None, base[7].tolist())]:
            x = np.array(integers(v))
            for c in range(4):
                r = by[i, c + 1]
                want = float((x - total / n) @ vector[:, c] / np.sqrt(value[c]))
                if abs(want) > 1e-6:
                    sign.setdefault(c, np.sign(want * r.whitened))
                    assert r.whitened == pytest.approx(want * sign[c], rel=1e-7, abs=1e-7)
                assert r.n == n == 300 and r.deviation == int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, total, strict=True)))
                assert r.explained == pytest.approx(value[c] / value.sum(), rel=1e-9)

    def test_small_and_empty_tables(self, spark):
        assert whitening.whiten(vectors(spark, [])).count() == 0
        assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
        two = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [9.0])])).collect()
        assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9)), r.explained) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]

    def test_lengths_apart_and_huge_entries(self, spark):
        rng = np.random.default_rng(2)
        rows = [(i, rng.normal(size=8).tolist()) for i in range(50)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(20)]
        alone = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(vectors(spark, rows[:50])).collect()}
        both = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(vectors(spark, rows)).collect()}
        assert all(both[k] == pytest.approx(v, abs=1e-9) for k, v in alone.items()) and len(both) == 50 * 4 + 20 * 3
        huge = whitening.whiten(vectors(spark, rows[50:] + [(999, [3e38, -3e38, 0.0])])).collect()
        assert all(math.isfinite(r.whitened) for r in huge) and any(r.deviation is None for r in huge)

    @pytest.mark.parametrize("values", [
        np.linspace(1, 2, 40), np.r_[np.full(10, 5.0), np.full(30, 1.0)], np.r_[5 + 1e-7 * np.arange(10), np.linspace(1, 2, 30)],
        np.r_[5 + 1e-10 * np.arange(8), 5 + 1e-4 * np.arange(12), np.linspace(1, 2, 20)], 10.0 ** np.linspace(-12, 3, 40), np.zeros(40)])
    def test_clustered_eigenvalues(self, values):
        q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(40, 40)))
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        found, x = whitening.eigenvectors(a)
        scale = max(np.abs(values).max(), 1e-300)
        assert np.abs(a @ x - x * found).max() / scale < 1e-14 and np.abs(x.T @ x - np.eye(40)).max() < 1e-14
        assert np.allclose(found, np.sort(values)[::-1], atol=1e-14 * scale) and (np.diff(found) <= 0).all()

    def test_one_step_squares_the_error(self):
        rng = np.random.default_rng(4)
        a = rng.normal(size=(60, 30))
        a = whitening.extended(a.T @ a / 60)
        _, first = np.linalg.eigh(a.astype(np.float32))
        one, _, change, _ = whitening.corrected(a, whitening.extended(first))
        _, _, again, _ = whitening.corrected(a, one)
        assert change < 1e-3 and again < 1e3 * change ** 2


class TestCentroids:
    def by_hand(self, rows, k=40, rounds=5):
        kept = [(i, tuple(integers(v))) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
        order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
        middle = [x for _, x in order[:k]]

        def near(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(middle))

        for _ in range(rounds):
            own = defaultdict(list)
            for _, x in kept:
                own[near(x)[1]].append(x)
            middle = [tuple(sum(c) // len(own[j]) for c in zip(*own[j], strict=True)) if j in own else m for j, m in enumerate(middle)]
        met = [(i, *near(x)) for i, x in kept]
        total = Counter()
        for _, d, j in met:
            total[j] += d
        return Counter((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest()) for i, d, j in met)

    def rows(self, n=260, seed=1):
        rng = np.random.default_rng(seed)
        own = rng.normal(size=(7, 64))
        x = own[rng.integers(0, 7, n)] + rng.normal(size=(n, 64)) * 0.2
        x[40:110] = x[3]
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        return rows + [(5, x[9].tolist()), (5, x[5].tolist()), (None, x[11].tolist()), (900, None), (901, [1.0] * 63), (902, [None] * 64), (903, [float("nan")] * 64)]

    @pytest.mark.parametrize("block", [256, 16])
    def test_equals_brute_force(self, spark, monkeypatch, block):
        monkeypatch.setattr(centroids, "BLOCK", block)
        rows = self.rows()
        out = centroids.cluster(vectors(spark, rows).repartition(3)).collect()
        assert Counter(tuple(r) for r in out) == self.by_hand(rows)

    def test_huge_components_stay_exact(self, spark):
        rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(np.random.default_rng(5).normal(size=(12, 64)) * 1e5)]
        out = centroids.cluster(vectors(spark, rows), k=3, rounds=2).collect()
        assert Counter(tuple(r) for r in out) == self.by_hand(rows, 3, 2)
        assert centroids.cluster(vectors(spark, [*rows, (99, [3e38] * 64)]), k=13).count() == 13

    def test_empty_and_fewer_than_k(self, spark):
        assert centroids.cluster(vectors(spark, [])).count() == 0
        assert centroids.cluster(vectors(spark, [(None, [1.0] * 64)])).count() == 0
        rows = [(i, [float(i)] * 64) for i in range(3)]
        assert Counter(tuple(r) for r in centroids.cluster(vectors(spark, rows)).collect()) == self.by_hand(rows)

    def test_no_nearest_centroid_is_ruled_out(self):
        rng = np.random.default_rng(6)
        middle = rng.integers(-300, 300, (40, 64))
        few = 0
        for spread in (0, 5, 60, 300):
            x = middle[3] + rng.integers(-spread, spread + 1, (50, 64))
            low, high = x.min(axis=0), x.max(axis=0)
            number, distance = centroids.nearest(x, low, high, middle)
            exact = ((x[:, None] - middle[None]) ** 2).sum(axis=2)
            assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
            few += len(centroids.candidates(low, high, middle)) < 40
        assert few >= 2

    @pytest.mark.parametrize(("width", "bits"), [(2, 3), (3, 2), (5, 2)])
    def test_neighbours_along_the_curve_touch(self, width, bits):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width), -1).reshape(-1, width)
        place = [bytes(key) for key in centroids.hilbert(cells, bits)]
        walk = cells[sorted(range(len(cells)), key=place.__getitem__)]
        assert len(set(place)) == len(cells) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()

    def test_query(self, spark):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
        assert Counter(tuple(r) for r in queries.op13_centroids(spark, SF).collect()) == self.by_hand(rows)


class TestPipelineRows:
    def texts(self):
        rnd = random.Random(8)
        return [" ".join(f"v{rnd.randrange(900)}" for _ in range(60)) for _ in range(6)]

    def stage(self, spark, name, rows):
        out = dict(corpus_pipeline.STAGES)[name](spark, documents(spark, rows), SF)
        assert out.columns == corpus_pipeline.COLUMNS
        return Counter((r.doc_id, r.text) for r in out.collect())

    def test_no_unique_text_goes_for_its_id(self, spark):
        a, b, c, d, e, _ = self.texts()
        rows = [(3, a), (None, a), (None, b), (5, a), (5, c), (7, d), (7, d), (None, None), (8, ""), (9, e + " tail")]
        assert self.stage(spark, "near_duplicates", rows) == Counter([(3, a), (None, b), (5, c), (7, d), (None, None), (8, ""), (9, e + " tail")])

    def test_no_clean_text_goes_for_a_leak(self, spark):
        a, b, c, d, _, _ = self.texts()
        item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").first().text
        rows = [(9, a), (9, b + " " + item), (None, c), (None, d + " " + item), (4, item), (5, None)]
        assert self.stage(spark, "decontamination", rows) == Counter([(9, a), (None, c), (5, None)])

    def test_passages_under_repeated_ids(self, spark):
        a, b, c, d, _, _ = self.texts()
        rows = [(1, a), (2, b + " " + a), (2, c), (None, d), (None, a), (6, None)]
        assert self.stage(spark, "substring_dedup", rows) == Counter([(1, a), (2, b), (2, c), (None, d), (None, ""), (6, "")])

    def test_quality_keeps_columns_and_rows(self, spark):
        a, b, *_ = self.texts()
        rows = [(1, a), (None, b), (2, None), (2, a), (2, a)]
        out = self.stage(spark, "quality", rows)
        assert set(out) <= {(1, a), (None, b), (2, None), (2, a)} and out[2, a] in (0, 2)

    def test_packing_takes_every_row(self, spark):
        a, b, *_ = self.texts()
        rows = [(1, a), (None, b), (2, None), (2, a), (2, a)]
        pieces = corpus_pipeline.sequences(spark, documents(spark, rows), SF).collect()
        assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(i for i, _ in rows)

    def test_keys_follow_ids_and_part_copies(self, spark):
        a, b, *_ = self.texts()
        rows = corpus_pipeline.keyed(documents(spark, [(None, a), (4, b), (4, a), (1, a), (None, a), (1, a)])).orderBy("key").collect()
        assert [r.doc_id for r in rows] == [1, 1, 4, 4, None, None] and len({r.key for r in rows}) == 6
        plain = corpus_pipeline.keyed(documents(spark, [(4, b), (2, a)]))
        assert {(r.doc_id, r.key) for r in plain.collect()} == {(4, 4), (2, 2)}
