import json
import os

from logpond.sources.benchfiles import read_queue_depth, read_run_summaries, run_verdicts

LOAD_S = 20


def _run(root, cfg, rps, p99_ns, pending):
    d = os.path.join(root, cfg, f"{rps}rps")
    os.makedirs(d)
    with open(os.path.join(d, "metrics.json"), "w") as f:
        json.dump({"latencies": {"total": 1, "mean": 500000, "50th": 1, "90th": 1, "95th": 1, "99th": p99_ns,
                                 "max": 1, "min": 1}, "requests": rps * LOAD_S, "rate": float(rps),
                   "duration": LOAD_S * 10 ** 9,
                   "throughput": float(rps), "success": 1.0, "status_codes": {"202": rps * LOAD_S}, "errors": []},
                  f, indent=2 if rps % 2 else None)
    with open(os.path.join(d, "queue_depth.csv"), "w") as f:
        f.write("timestamp,pending_messages\n")
        for i, p in enumerate(pending):
            f.write(f"2025-01-01 00:00:{i:02d},{p}\n")


def _growing(step):
    """Grows while the load is on, then drains to nothing."""
    up = [i * step for i in range(LOAD_S)]
    return up + [max(0, up[-1] - 4 * step * i) for i in range(1, 10)]


HUMP = [0, 300, 700, 900, 1100, 1000, 900, 800, 800, 700, 600, 500, 500, 400, 300, 300, 200, 200, 100, 50] + [0] * 9


def test_reader_and_verdicts(spark, tmp_dir):
    root = tmp_dir + "/bench"
    flat = [0, 5, 3, 4, 2, 3, 2, 1] * 3 + [0] * 5
    _run(root, "v3/grpc", 1000, 800_000, flat)
    _run(root, "v3/grpc", 2000, 900_000, HUMP)
    _run(root, "v3/grpc", 3000, 1_200_000, _growing(200))       # drained in the end, but unstable
    _run(root, "v3/grpc", 4000, 1_200_000, flat)                # above the first failure: no ceiling
    _run(root, "v1", 500, 800_000, flat)
    _run(root, "v1", 600, 150_000_000, flat)                    # too slow
    assert read_run_summaries(spark, root).count() == 6
    assert read_queue_depth(spark, root).count() == 29 * 6
    rows = run_verdicts(spark, root).collect()
    v = {(r["config_path"], r["rps"]): r for r in rows}
    assert set(c for c, _ in v) == {"v3/grpc", "v1"}            # named below the root
    assert [v["v3/grpc", k]["stable"] for k in (1000, 2000, 3000, 4000)] == [True, True, False, True]
    assert v["v3/grpc", 3000]["peak_pending"] == 200 * (LOAD_S - 1)
    assert v["v3/grpc", 1000]["ceiling_rps"] == 2000 and v["v1", 500]["ceiling_rps"] == 500
    assert abs(v["v3/grpc", 2000]["p99_ms"] - 0.9) < 1e-9
