import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.operators import features as X
from tidemark.operators import gates as G
from tidemark.operators import modeling as M
from tidemark.operators import regime as R
from tidemark.operators import strategies as T
from tidemark.operators.textscan import catalogue, digest_window_scan, phrase_scan
from tidemark.sources import jsonl, snapshots
from tidemark.sources.synthetic import synthetic_bars


def stream(spark, xs):
    return spark.createDataFrame([("k", i + 1, float(x)) for i, x in enumerate(xs)], "k string, row_idx long, x double")


def test_ks_golden_alarms(spark):
    rng = random.Random(23)
    xs = [rng.gauss(0.0, 1.0) for _ in range(200)] + [rng.gauss(1.5, 1.0) for _ in range(200)]
    out = D.ks_window(stream(spark, xs), ["k"]).orderBy("row_idx").collect()
    fired = [r.row_idx for r in out if r.ks_alarm]
    assert (len(fired), fired[-1], out[-1].ks_d) == (119, 348, pytest.approx(0.125))
    want = serial_ks(xs)
    assert [r.row_idx for r in out if r.ks_alarm] == [i for i, _ in want if _[1]]
    assert [r.ks_d for r in out if r.ks_d is not None] == pytest.approx([_[0] for i, _ in want if _[0] is not None])


def serial_ks(xs, ref_n=200, rec_n=50, least=30, c=1.628):
    ref, rec, out = [], [], []
    for i, x in enumerate(xs, 1):
        if len(ref) < ref_n:
            ref.append(x)
            out.append((i, (None, False)))
            continue
        rec.append(x)
        if len(rec) > rec_n:
            ref = ref[1:] + [rec.pop(0)]
        if len(rec) < least:
            out.append((i, (None, False)))
            continue
        d = max(abs(sum(v <= t for v in ref) / len(ref) - sum(v <= t for v in rec) / len(rec)) for t in ref + rec)
        out.append((i, (d, d > c * math.sqrt((len(ref) + len(rec)) / (len(ref) * len(rec))))))
    return out


def test_page_hinkley_and_ewma_equal_the_loop(spark):
    rng = random.Random(5)
    xs = [abs(rng.gauss(0.2, 0.05)) for _ in range(150)] + [abs(rng.gauss(0.5, 0.05)) for _ in range(150)]
    f = D.page_hinkley(stream(spark, xs), ["k"], threshold=2.0)
    f = D.ewma_drift(f, ["k"], k_sigma=2.0)
    out = f.orderBy("row_idx").collect()
    n = mean = cum = lo = hi = 0.0
    fast = slow = var = 0.0
    for r, x in zip(out, xs):
        n += 1
        mean += (x - mean) / n
        cum += x - mean - 1e-4
        lo, hi = min(lo, cum), max(hi, cum)
        if n == 1:
            fast = slow = x
        else:
            diff = x - fast
            fast, var, slow = 0.1 * x + 0.9 * fast, 0.1 * diff * diff + 0.9 * var, 0.005 * x + 0.995 * slow
        assert r.ph_cum == pytest.approx(cum, abs=1e-9)
        assert r.ph_alarm == (n >= 30 and (cum - lo > 2.0 or hi - cum > 2.0))
        assert (r.fast_ewma, r.slow_mean, r.ewma_var) == pytest.approx((fast, slow, var), abs=1e-12)
        assert r.ewma_alarm == (n >= 30 and var > 0 and abs(fast - slow) > 2.0 * math.sqrt(var))


def test_regimes_and_features_do_not_look_ahead(spark):
    bars = synthetic_bars(spark, n=220, series=2).cache()
    cut = bars.filter("row_idx <= 150")
    for make, cols in ((R.regime_labels, ("coarse", "fine")), (X.feature_frame, ("rsi_14", "sma72_rel", "ema_distance", "realized_vol"))):
        full = make(bars).filter("row_idx <= 150").select("series_id", "row_idx", *cols)
        part = make(cut).select("series_id", "row_idx", *[F.col(c).alias(f"{c}_p") for c in cols])
        both = full.join(part, ["series_id", "row_idx"]).collect()
        assert len(both) == 300
        for r in both:
            for c in cols:
                assert r[c] == (pytest.approx(r[f"{c}_p"], abs=1e-12) if isinstance(r[c], float) else r[f"{c}_p"])


def test_targets_drop_the_tail_and_are_strict(spark):
    rows = [("s", i + 1, i, c) for i, c in enumerate([1.0, 1.0, 2.0, 0.0, 3.0])]
    bars = spark.createDataFrame(rows, "series_id string, row_idx long, open_time_ms long, close double")
    got = X.direction_target(bars, {"1h": 1}).orderBy("row_idx").select("row_idx", "y").collect()
    assert [(r.row_idx, r.y) for r in got] == [(1, 0), (2, 1)]


def test_folds_purge_and_embargo(spark):
    sizes = spark.createDataFrame([("s", 130)], "series_id string, n_rows long")
    got = M.walk_forward(sizes, ["series_id"], 5, 2, 1, 30).orderBy("fold_id").collect()
    assert [(r.fold_id, r.train_end, r.test_start, r.test_end) for r in got] == [(1, 48, 51, 70), (2, 68, 71, 90), (3, 88, 91, 110), (4, 108, 111, 130)]


def test_each_gate_alone_blocks(spark):
    good = dict(candidate_id="c", horizon="24h", resolved_total=50, resolved_horizon=50, shadow_days=20, brier=0.20, log_loss=0.6, ece=0.01,
                best_baseline_brier=0.25, drift_alarms=0, n_folds=4, regimes_covered=2, approved_by="me", approved_at="now")
    breaks = dict(resolved_total=1, resolved_horizon=1, shadow_days=1, brier=0.3, log_loss=0.9, ece=None, best_baseline_brier=0.2, drift_alarms=1, n_folds=1, regimes_covered=1, approved_by=None)
    ddl = "candidate_id string, horizon string, resolved_total long, resolved_horizon long, shadow_days long, brier double, log_loss double, ece double, best_baseline_brier double, drift_alarms long, n_folds long, regimes_covered long, approved_by string, approved_at string"
    rows = [good] + [{**good, "candidate_id": k, k: v} for k, v in breaks.items()]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ddl.split(", ")) for r in rows], ddl)
    got = {r.candidate_id: r for r in G.promotion_decision(G.promotion_gates(df)).collect()}
    assert got.pop("c").ready_for_promotion
    assert all(not r.ready_for_promotion and len(r.failing) >= 1 for r in got.values())
    open_gate = G.promotion_decision(G.promotion_gates(df.filter("candidate_id = 'ece'"), {"max_ece": 1.0})).first()
    assert not open_gate.ready_for_promotion


def test_max_pain_equals_brute_force(spark):
    rng = random.Random(3)
    book = [("e", k * 100, float(rng.randint(0, 50)), float(rng.randint(0, 50))) for k in range(1, 30)]
    strikes = spark.createDataFrame(book, "expiry string, strike long, call_oi double, put_oi double")
    pain = {p: sum(c * max(0, p - k) + q * max(0, k - p) for _, k, c, q in book) for _, p, _, _ in book}
    got = T.opt_max_pain(strikes).first()
    assert got.pain == pytest.approx(min(pain.values())) and pain[got.max_pain] == min(pain.values())


def test_digest_window_crosses_chunk_borders(spark):
    import hashlib

    text = "".join(chr(97 + (i * 7) % 26) for i in range(900)) + "\n" + "z" * 40
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    for at in (0, 10, 13, 250, 255, 256, 880):
        secret = spark.createDataFrame([(hashlib.sha256(text[at:at + 12].encode()).hexdigest(),)], "digest string")
        assert [r.doc_id for r in digest_window_scan(docs, "doc_id", secret, 12, chunk=16).collect()] == [1]
    broken = spark.createDataFrame([(hashlib.sha256(text[895:907].encode()).hexdigest(),)], "digest string")
    assert digest_window_scan(docs, "doc_id", broken, 12).count() == 0


def test_phrases_skip_comments_and_disclaimer_lines(spark):
    rows = [(1, "You should act. Guaranteed!"), (2, "/* guaranteed */ fine"), (3, "  // you should\nfine"), (4, "Guaranteed? Not financial advice."),
            (5, "No buy. Not financial advice.\nUncapped, sin tope\n12% projected savings vs AWS"), (6, "MVRV Z-Score: 0.41 and mvrv z-score: 0.41"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.kind, r.phrase) for r in phrase_scan(docs, "doc_id", catalogue(spark)).collect()}
    assert {(i, p) for i, k, p in got if k == "term"} == {(1, "you should"), (1, "guaranteed")}
    assert {(i, p) for i, k, p in got if k == "stale"} == {(6, "MVRV Z-Score: 0.41")}
    assert [i for i, k, _ in got if k == "pattern"] == [5, 5]


def test_digest_window_of_a_very_long_text(spark):
    import hashlib

    secret = spark.createDataFrame([(hashlib.sha256(b"needle-in-hay").hexdigest(),)], "digest string")
    docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.concat(F.repeat(F.lit("\n"), 5_000_000), F.lit("needle-in-hay")).alias("text"))
    assert digest_window_scan(docs, "doc_id", secret, 13).count() == 1


def test_dated_files_are_indexed(spark, tmp_path):
    (tmp_path / "2024-01-02.json").write_text('{"id": "x", "title": ""}')
    (tmp_path / "2024-01-03.json").write_text("{broken")
    (tmp_path / "index.json").write_text("{}")
    got = [(r.date, r.id, r.title) for r in snapshots.index_by_date(snapshots.read_dated(spark, str(tmp_path))).collect()]
    assert got == [("2024-01-03", "briefing-2024-01-03", "Daily briefing 2024-01-03"), ("2024-01-02", "x", "Daily briefing 2024-01-02")]


def test_reports_are_written_sorted(spark, tmp_path):
    jsonl.sink_report(spark.createDataFrame([(2, None)], "b int, a string"), str(tmp_path / "r"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    assert text.index('"a"') < text.index('"b"') and "null" in text


def test_merge_is_idempotent_and_first_writer_wins(spark):
    ddl = "series_id string, open_time_ms long, close double, arrival int"
    old = spark.createDataFrame([("s", 1, 1.0, 0), ("s", 1, 1.5, 1)], ddl)
    new = spark.createDataFrame([("s", 1, 9.0, 0), ("s", 2, 2.0, 0), ("s", 2, 3.0, 1)], ddl)
    once = snapshots.merge_idempotent(old, new)
    twice = snapshots.merge_idempotent(once, new)
    want = [("s", 1, 1.5), ("s", 2, 2.0)]
    for df in (once, twice):
        assert sorted((r.series_id, r.open_time_ms, r.close) for r in df.collect()) == want


def test_lenient_scan_counts_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"event_id": 1, "series_id": "a", "price": 2.0}\n\n{broken\n[1]\n{"event_id": 2, "series_id": "b", "price": 3.0}\n')
    from tidemark.plans.q_sources import LINE

    rows, bad = jsonl.scan_jsonl_lenient(spark, str(tmp_path / "x.jsonl"), LINE)
    assert sorted(r.event_id for r in rows.collect()) == [1, 2] and bad.first().skipped == 2


def test_synthetic_bars_are_repeatable_and_valid(spark):
    from tidemark.operators.bars import validate_bars

    a, b = synthetic_bars(spark, n=100), synthetic_bars(spark, n=100)
    assert a.exceptAll(b).count() == 0
    assert validate_bars(a).filter(F.size("faults") > 0).count() == 0
