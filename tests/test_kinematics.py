import numpy as np
import pytest

from kelpline.operators import embodiment, episodes, kinematics, routing, stats
from kelpline.operators.kinematics import Joint

ARM = [
    Joint("a", "base", "l1", axis=(0, 0, 1), place=(0, 0, 0.1)), Joint("b", "l1", "l2", axis=(0, 1, 0), place=(0.3, 0, 0)), Joint("c", "l2", "l3", axis=(0, 1, 0), place=(0.3, 0, 0)),
    Joint("d", "l3", "l4", axis=(1, 0, 0), place=(0.1, 0, 0)), Joint("e", "l4", "l5", axis=(0, 1, 0), place=(0.1, 0, 0)), Joint("f", "l5", "l6", axis=(1, 0, 0), place=(0.05, 0, 0)),
    Joint("tip", "l6", "hand", kind="fixed", place=(0.05, 0, 0)), Joint("other", "l1", "side", kind="prismatic"),
]


def quaternion(r):
    w = np.sqrt(max(0, 1 + np.trace(r))) / 2
    return [(r[2, 1] - r[1, 2]) / (4 * w), (r[0, 2] - r[2, 0]) / (4 * w), (r[1, 0] - r[0, 1]) / (4 * w), w]


def test_chain():
    chain = kinematics.chain_to(ARM, "hand")
    assert [j.name for j in chain] == ["a", "b", "c", "d", "e", "f", "tip"] and [j.name for j in kinematics.chain_to(ARM, "l3", "l1")] == ["b", "c"]
    with pytest.raises(ValueError):
        kinematics.chain_to(ARM, "side", "l2")
    pose, _ = kinematics.forward(chain, dict.fromkeys("abcdef", 0.0))
    assert np.allclose(pose[:3, 3], [0.9, 0, 0.1])


def test_episodes_are_solved_from_step_to_step(spark):
    chain = kinematics.chain_to(ARM, "hand")
    rows = []
    for k, ep in enumerate(("x", "y")):
        for t in range(5):
            q = {n: 0.3 + 0.05 * t + 0.1 * k + 0.02 * i for i, n in enumerate("abcdef")}
            pose = kinematics.forward(chain, q)[0]
            rows.append((ep, t, [*map(float, pose[:3, 3]), *map(float, quaternion(pose[:3, :3]))]))
    df = spark.createDataFrame(rows, "episode string, t long, pose array<double>")
    out = kinematics.solved(df, chain, "episode", "t", start=dict.fromkeys("abcdef", 0.25))
    back = {(r["episode"], r["t"]): r["position"] for r in kinematics.reached(out, chain, ["episode", "t"]).collect()}
    assert all(np.allclose(back[e, t], p[:3], atol=1e-5) for e, t, p in rows)
    with pytest.raises(ArithmeticError):
        kinematics.inverse(chain, kinematics.matrix([9, 9, 9, 0, 0, 0, 1]), {}, most=30)


def test_strict_variants(spark):
    df = spark.createDataFrame([("x", 1, 1.0, 5.0), ("x", 2, 2.0, 4.0), ("y", 1, 1.0, 1.0)], "ep string, t long, a double, b double")
    with pytest.raises(Exception, match="single frame"):
        episodes.episode_offsets(df, "ep", strict=True).collect()
    with pytest.raises(Exception, match="not positive"):
        stats.linear_fit(df.where("ep = 'x'"), ["ep"], "a", "b", rising=True).collect()
    with pytest.raises(Exception, match="empty"):
        episodes.train_validation_split(df.limit(1), "t", 0.5, 1).collect()
    limits = spark.createDataFrame([("x", 0.0, None)], "ep string, low double, high double")
    assert embodiment.with_limits(df.where("ep = 'x'"), limits, "ep").count() == 2
    with pytest.raises(Exception, match="no such joint: y"):
        embodiment.with_limits(df, limits, "ep").collect()


def test_flush_barrier(spark):
    w = spark.createDataFrame([(1,), (2,), (3,)], "window_id long")
    p = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "window_id long, producer string")
    f = spark.createDataFrame([(1, "a"), (2, "a"), (2, "z")], "window_id long, producer string")
    assert sorted(r[0] for r in routing.flushed(w, p, f).collect()) == [2, 3]
