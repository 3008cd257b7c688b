"""Robust planes and seeded samples."""

from landfold.operators import summaries as s


def test_plane_survives_outliers_and_sample_repeats(spark):
    rows = [("a", float(i % 20), 0.2 * (i % 20) - 0.1 * (i // 20) + 3 + (25.0 if i % 4 == 0 else 0.0), float(i // 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    p = s.fit_plane(df, "k").first()
    assert abs(p.a - 0.2) < 1e-6 and abs(p.b + 0.1) < 1e-6 and abs(p.c - 3) < 1e-6 and p.inliers == 300 and p.rms < 1e-4
    a = {tuple(r) for r in s.qa_sample(df, 50, 1, "x", "z").collect()}
    assert len(a) == 50 and a == {tuple(r) for r in s.qa_sample(df.repartition(7), 50, 1, "x", "z").collect()}
