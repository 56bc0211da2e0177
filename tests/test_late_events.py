import datetime as dt

import pytest

from tidewatch.streaming.late_events import LateEvents

SCHEMA = "mention_id string, published_at string, collected_at string, community string, engagement_score double, extra string, week_start string"


def put(spark, path, rows, files=1):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(str(path))
    return str(path)


def run(spark, tmp_path, rows, files=1, **options):
    return LateEvents(**options).run(spark, put(spark, tmp_path / "raw.parquet", rows, files))


ROWS = [
    # the week of Tuesday 2026-03-03 closes on the 10th and takes records to the 17th
    ("a", "2026-03-03T10:00:00Z", "2026-03-03T11:00:00Z", "x", 1.0, None, None),
    ("a", "2026-03-03T10:00:00Z", "2026-03-16T23:59:59Z", "x", 5.0, None, None),
    ("a", "2026-03-03T10:00:00Z", "2026-03-17T00:00:00Z", "x", 9.0, None, None),
    ("b", "2026-03-09T23:59:59+00:00", "2026-03-17 00:00:00", "x", 2.0, "", "clash"),
    ("b", "2026-03-09T23:59:59+00:00", "2026-03-17 00:00:00", "x", 2.0, "", "clash"),
    ("c", "2026-03-10T00:00:00Z", "2026-03-17T00:00:00Z", None, None, None, None),
    ("d", "just now", "2026-03-17T00:00:00Z", "x", 1.0, None, None),
    ("e", "2026-03-10T00:00:00Z", None, "x", 1.0, None, None),
    (None, "2026-03-10T00:00:00Z", "2026-03-30T00:00:00Z", "x", 1.0, None, None),
    (" ", "2026-03-10T00:00:00Z", "2026-03-30T00:00:00Z", "x", 1.0, None, None),
    ("nan", "2026-03-10T00:00:00Z", "2026-03-30T00:00:00Z", "x", 1.0, None, None),
    ("f", "2026-03-10T01:30:00+02:00", "2026-03-16T22:00:00-01:00", "y", 3.0, None, None),
]


def test_cut_off_and_latest_version(spark, tmp_path):
    done = run(spark, tmp_path, ROWS)
    assert {r[0] for r in done.only_late().collect()} == {"b"}
    figures = {(r["week_start"], r["community"]): r for r in done.weeks().collect()}
    assert figures["2026-03-03", "x"]["posts"] == 1 and figures["2026-03-03", "x"]["avg_engagement"] == 5.0
    assert figures["2026-03-10", ""]["avg_engagement"] == 0.0 and figures["2026-03-03", "y"]["records"] == 1
    report = {r["week_start"]: r for r in done.late_report().collect()}
    assert report["2026-03-03"]["late_records"] == 3 and report["2026-03-03"]["posts_only_late"] == 1
    aside = sorted((r["mention_id"], r["reason"], r["week_start"]) for r in done.aside().collect())
    assert aside == [("a", "late", "2026-03-03"), ("b", "late", "2026-03-03"), ("b", "late", "2026-03-03"), ("d", "unreadable", None), ("e", "unreadable", "2026-03-10")]
    assert {(r["reason"], r["records"]) for r in done.reasons().collect()} == {("late", 3), ("unreadable", 2)}


def test_order_and_files_do_not_matter(spark, tmp_path):
    def shown(done):
        return [sorted(map(str, df.collect())) for df in (done.posts(), done.weeks(), done.aside(), done.only_late())]

    assert shown(run(spark, tmp_path / "1", ROWS)) == shown(run(spark, tmp_path / "2", ROWS[::-1], files=6))


def test_empty_table(spark, tmp_path):
    done = run(spark, tmp_path, [])
    assert [df.count() for df in (done.posts(), done.weeks(), done.aside(), done.only_late(), done.late_report())] == [0] * 5


@pytest.mark.parametrize("rocks", [False, True])
def test_runs_go_on_where_the_last_one_ended_and_state_stays_bounded(spark, tmp_path, rocks):
    """A run a week for fourteen weeks, each with the week's posts, a correction of the week before, a late record and, at
    the end, one that is out of order by more than the slack."""
    first, path, home = dt.datetime(2026, 1, 6), tmp_path / "raw.parquet", str(tmp_path / "home")
    text = lambda days: (first + dt.timedelta(days=days)).isoformat() + "Z"
    sizes, expected = [], {}
    for week in range(14):
        at = 7 * week
        rows = [(f"w{week}-{i}", text(at + i % 7), text(at + i % 7 + 0.1), "x", 1.0, None, None) for i in range(20)]
        rows.append((f"w{week}-0", text(at), text(at + 6.9), "x", 21.0, None, None))
        if week:
            rows.append((f"w{week - 1}-1", text(at - 6), text(at + 6.8), "x", 21.0, None, None))
        if week > 3:
            rows.append((f"w{week - 4}-2", text(at - 26), text(at + 1), "x", 99.0, None, None))
        if week == 13:
            rows.append(("gap", text(1), text(2), "x", 1.0, None, None))
        late = LateEvents(rocks=rocks)
        done = late.run(spark, put(spark, path, rows), home)
        sizes.append(late.state_rows[-1])
        expected[text(at)[:10]] = (20, 21 if week == 13 else 22, round((18 + 21 + (1.0 if week == 13 else 21.0)) / 20, 6))
        if week in (0, 13):
            found = {r["week_start"]: (r["posts"], r["records"], r["avg_engagement"]) for r in done.weeks().collect()}
            if week == 0:
                assert found == {"2026-01-06": (20, 21, 2.0)}
    assert found == expected
    # about three weeks are open at any time
    assert max(sizes) <= 4 * 20 and sizes[-1] == sizes[-2] == sizes[-3]
    assert {r["reason"]: (r["records"], r["posts"]) for r in done.reasons().collect()} == {"late": (10, 10), "closed": (1, 1)}
