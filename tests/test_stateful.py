"""Stateful streams against plain batch rules, over several starts from one checkpoint."""

import random
from datetime import datetime, timedelta

from ledgerloom.streaming import stateful

START = datetime(2026, 1, 1)


def plain_sessions(events, threshold, idle):
    """(key, source, text, why) by the rules as stated, one key after another."""
    out = []
    for key in sorted({e[0] for e in events}):
        text, source, last = "", None, None
        for _, src, kind, said, ts, seq in sorted((e for e in events if e[0] == key), key=lambda e: (e[4], e[5])):
            at, moved = (ts - START).total_seconds(), False
            if text and at - last >= idle:
                out.append((key, source, text, "idle"))
                text = ""
            if text and src != source:
                out.append((key, source, text, "switch"))
                text, moved = "", True
            if not text:
                source = src
            last = at
            text = text[:-1] if kind == "backspace" else text + {"enter": " [Enter] ", "tab": " [Tab] "}.get(kind, said)
            if not moved and text and (kind in ("enter", "tab") or len(text.encode()) >= threshold):
                out.append((key, source, text, "end" if kind in ("enter", "tab") else "length"))
                text = ""
        if text:
            out.append((key, source, text, "idle"))
    return sorted(out)


def replay(spark, tmp_path, batches, schema, build):
    """Runs `build` over the batches, one start each, and returns all rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_text_sessions(spark, tmp_path):
    rng, at, events = random.Random(6), 0, []
    for seq in range(160):
        at += rng.choice([0, 1, 1, 2, 45])
        kind = rng.choice(["key"] * 8 + ["enter", "tab", "backspace"])
        events.append((rng.choice("ab"), rng.choice(["x", "x", "x", "y"]), kind, rng.choice(["q", "ß", "word "]), START + timedelta(seconds=at), seq))
    end = [("z", "x", "enter", "", START + timedelta(days=1), 999), ("z", "x", "enter", "", START + timedelta(days=2), 1000)]
    batches = [events[:60], events[60:61], events[61:130], events[130:], end[:1], end[1:]]
    got = replay(spark, tmp_path, batches, "key string, source string, kind string, text string, ts timestamp, seq long", lambda s: stateful.text_sessions(s, threshold=12, idle=30))
    want = plain_sessions(events, 12, 30)
    assert sorted((r.key, r.source, r.text, r.why) for r in got if r.key != "z") == want
    assert {w[3] for w in want} == {"idle", "switch", "end", "length"}


def test_trailing_alerts_are_those_of_the_batch_rule(spark, tmp_path):
    rng, at, rows = random.Random(7), 0, []
    for tx in range(150):
        at += rng.choice([0, 60, 4_000, 30_000])
        rows.append((rng.randrange(2), tx, rng.randrange(1, 100), START + timedelta(seconds=at)))
    mixed = [r for k in range(0, 150, 25) for r in rng.sample(rows[k : k + 25], 25)]
    late = [(9, 900, 1, START + timedelta(days=900)), (9, 901, 1, START + timedelta(days=901))]
    batches = [mixed[:50], mixed[50:100], mixed[100:], late[:1], late[1:]]
    got = replay(spark, tmp_path, batches, "account long, tx_id long, amount long, ts timestamp", lambda s: stateful.trailing_alerts(s, floor=150, least=3, late="30 days"))
    want = set()
    for account, tx, _, ts in rows:
        window = [r for r in rows if r[0] == account and timedelta() <= ts - r[3] <= timedelta(days=1)]
        if len(window) >= 3 and sum(r[2] for r in window) >= 150:
            want.add((account, tx, len(window), sum(r[2] for r in window)))
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 5
