import datetime
import hashlib

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textassay.operators import pages, simhash
from textassay.plans import native
from textassay.streaming import jobs, stateful


@given(st.lists(st.integers(0, 500), max_size=40))
@settings(deadline=None)
def test_ttl_fold_splits_at_any_batch_boundary(times):
    times = sorted(times)
    whole, last = jobs.accept_ttl(times, [])
    for cut in range(len(times) + 1):
        a, mid = jobs.accept_ttl(times[:cut], [])
        b, end = jobs.accept_ttl(times[cut:], mid)
        assert a + b == whole and end == last
    accepted = [t for t, ok in zip(times, whole) if ok]
    assert all(b - a > jobs.TTL_SECONDS for a, b in zip(accepted, accepted[1:]))


@given(st.lists(st.integers(0, 20000), max_size=60))
@settings(deadline=None)
def test_rate_limit_never_accepts_more_than_the_limit(times):
    times = sorted(times)
    taken, _ = jobs.accept_rate(times, [])
    accepted = [t for t, ok in zip(times, taken) if ok]
    for t in accepted:
        assert sum(t - jobs.RATE_SECONDS < x <= t for x in accepted) <= jobs.RATE_LIMIT


def test_stream_rate_limit_equals_batch_fold(spark, sf_dir):
    got = {(r.user_id, r.event_id): r.accepted for r in jobs.rate_limit(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts").toPandas().sort_values(["ts", "event_id"])
    for user, own in rows.groupby("user_id"):
        seconds = own["ts"].map(pd.Timestamp.timestamp).tolist()
        taken, _ = jobs.accept_rate(seconds, [])
        assert [got[user, e] for e in own["event_id"]] == taken


def test_states_go_on_over_batches_that_cut_runs(spark, tmp_path):
    """A busy user, a quiet one and one without id arrive in two batches; both folds equal one fold over all rows."""
    rows = [(None if i % 5 == 0 else i % 5 // 3, i, datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=(i * 37) % 900 + (7200 if i > 60 else 0) + i), "ab"[i % 2]) for i in range(120)]
    rows.sort(key=lambda r: (r[2], r[1]))

    def arrive(part):
        spark.createDataFrame(part, "user_id long, event_id long, ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")

    for part in (rows[:50], rows[50:]):
        arrive(part)
        ttl = jobs.ttl_dedup(spark, str(tmp_path), f"{tmp_path}/ttl").collect()
        rate = jobs.rate_limit(spark, str(tmp_path), f"{tmp_path}/rate").collect()
        weights = jobs.weights(spark, str(tmp_path), f"{tmp_path}/weights").collect()
    for got, fold in ((ttl, jobs.accept_ttl), (rate, jobs.accept_rate)):
        want = {}
        for user in (None, 0, 1):
            own = [r for r in rows if r[0] == user]
            want |= dict(zip([r[1] for r in own], fold([r[2].timestamp() for r in own], [])[0], strict=True))
        assert len(got) == len(rows) and {r.event_id: r.accepted for r in got} == want
    want = {}
    for user, event, _, dim in rows:
        x, n = want.get((user, dim), (0.0, 0))
        want[user, dim] = max(-1.0, min(1.0, x + (event % 7 - 3) * 0.3)), n + 1
    assert {(r.user_id, r.dim): (r.weight, r.n) for r in weights} == {k: (round(x, 6), n) for k, (x, n) in want.items()}


def plain_simhash(text):
    total = [0] * 64
    for shingle in [text[i : i + 3] for i in range(len(text) - 2)] or ([text] if text else []):
        digest = int.from_bytes(hashlib.md5(shingle.encode()).digest()[:8], "little")
        total = [t + (1 if digest >> b & 1 else -1) for b, t in enumerate(total)]
    value = sum(1 << b for b, t in enumerate(total) if t > 0)
    return value - (1 << 64) if value >> 63 else value


@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=40), min_size=1, max_size=6), st.integers(1, 9))
@settings(deadline=None)
def test_simhash_equals_plain_python_however_texts_are_cut(texts, piece):
    whole, simhash.PIECE = simhash.PIECE, piece
    try:
        assert simhash.simhashes(texts, {}).tolist() == [plain_simhash(t) for t in texts]
    finally:
        simhash.PIECE = whole
    assert simhash.simhashes(texts, {}).tolist() == [plain_simhash(t) for t in texts]


def test_clusters_are_transitive_closure_of_pairs(spark, sf_dir):
    from textassay.plans import catalog

    clusters = {r.doc_id: r.cluster for r in native.near_dup_clusters(spark, sf_dir).collect()}
    for r in catalog.run("near_dup_pairs", spark, sf_dir).collect():
        assert clusters[r.left_id] == clusters[r.right_id]
    assert all(c <= d for d, c in clusters.items())


def test_main_block_prefers_article_and_drops_noise():
    body = "<p>" + "Some words of the article. " * 30 + "</p>"
    page = f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>menu</nav><div class='sidebar'>side</div><article><h1>Head</h1>{body}<aside>x</aside></article><footer>f</footer></body></html>"
    text = pages.main_block(page)
    assert text.startswith("Head\nSome words") and "menu" not in text and "side" not in text and "x" not in text.split()
    assert pages.main_block(None) == "" and pages.main_block("") == ""


def test_state_of_idle_keys_is_gone_and_replays_change_nothing(spark, tmp_path):
    """Read through the state data source: only users near the watermark keep a state."""
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(i % 20, i, start + datetime.timedelta(seconds=i), "a", "x") for i in range(200)]
    rows += [(99, 1000 + i, start + datetime.timedelta(hours=9, seconds=i), "a", "x") for i in range(5)]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, event_type string, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    first = {tuple(r) for r in jobs.rate_limit(spark, str(tmp_path), f"{tmp_path}/rate").collect()}
    with stateful.rocksdb(spark):
        state = spark.read.format("statestore").option("stateVarName", "recent").load(f"{tmp_path}/rate/checkpoint")
        assert {r.key[0] for r in state.select("key").collect()} == {'{"key":99}'}
    assert {tuple(r) for r in jobs.rate_limit(spark, str(tmp_path), f"{tmp_path}/rate").collect()} == first
    assert {tuple(r) for r in jobs.rate_limit(spark, str(tmp_path), f"{tmp_path}/again").collect()} == first


@given(st.lists(st.integers(0, 300), max_size=40), st.integers(1, 4), st.integers(1, 90))
@settings(deadline=None)
def test_jumping_folds_equal_a_step_a_row(times, limit, seconds):
    times = sorted(times)
    recent, want = [], []
    for t in times:
        recent = [x for x in recent if x > t - seconds]
        want.append(len(recent) < limit)
        recent += [t] * want[-1]
    assert stateful.accept_rate(limit, seconds)(times, []) == (want, recent)
    last, want = None, []
    for t in times:
        want.append(last is None or t - last > seconds)
        last = t if want[-1] else last
    assert stateful.accept_ttl(seconds)(times, [])[0] == want


def test_content_keys(spark):
    rows = spark.createDataFrame([(1, " https://A.b/C "), (2, "https://A.b/C "), (3, "some text"), (4, None), (5, "")], "i int, c string")
    got = {r.i: r.k for r in rows.select("i", stateful.content_key(F.col("c")).alias("k")).collect()}
    digest = lambda x: "hash:" + hashlib.sha256(x.encode()).hexdigest()[:16]
    assert got == {1: digest(" https://A.b/C "), 2: "url:https://a.b/c", 3: digest("some text"), 4: None, 5: digest("")}
