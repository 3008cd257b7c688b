"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Each text gives statistics of its words and lines, then a vector of transformed statistics. Per (language, source) a
minimum-covariance-determinant estimate is found by concentration steps: keep the COVERAGE of rows nearest to the
present centre, take their mean and covariance, and repeat until the determinant settles, STEPS times at most; of two starts
(medians with absolute deviations; mean and covariance of all) the smaller determinant wins. COVERAGE is the limit of
(n + p + 1) / 2n, so that the estimate holds with nearly half of a group's rows bad. Rows whose squared Mahalanobis
distance exceeds CUTOFF are rejected. Each variance gets a floor, since most statistics are zero on most texts; the
floors let each statistic alone exceed CUTOFF. A group of fewer than MIN_ROWS rows is judged
by the estimate of its language, and a small language by that of all rows.

Every step is one pass over the small table of vectors: moments combine before the shuffle, and the share of nearest
rows is an exact percentile over binned distances, of which a few thousand exist. Only a group's numbers are joined
back, sent to all tasks while the groups are few enough, so that a hot group's rows stay where they are. Rows that fail the base rules take no part in the estimates.

Null texts have no words and fail the base rules; a null language or source is the one named ''. Repeated rows
count each. An empty table gives no rows. Further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.session import cut_lineage

MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
COVERAGE = 0.5
STEPS = 20
SETTLED = 1e-9
MIN_ROWS = 100
#: fixed values: chi-square with 5 degrees of freedom at 0.9999, and the factor that makes the covariance of the nearest half consistent
CUTOFF = 25.745
CONSISTENCY = 1.914
#: ln(1 + words), ln(mean word length), square roots of the shares of symbols, repeated lines and repeated words; and their least deviations
FLOORS = (0.5, 0.07, 0.05, 0.12, 0.12)
P = len(FLOORS)
LATTICE = 1024
BINS = 64
#: numbers of so many groups (under 20 MB) are sent to every task; of more, they meet the rows by a shuffle
SENT_GROUPS = 40_000
KEY = ["level", "k_lang", "k_source"]
UPPER = [(i, j) for i in range(P) for j in range(i + 1)]

SPACE = r"[\\x20\\x09-\\x0D]"
NOT_SPACE = r"[^\\x20\\x09-\\x0D]"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed; one row per input row."""
    text = docs.select(F.col(id_col), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
                       F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    parts = text.select(id_col, "lang", "source", F.expr("regexp_count(text_, '[#*$%&|<>]')").alias("n_symbols"),
                        F.expr(f"filter(split(text_, '{SPACE}+'), w -> w <> '')").alias("words_"),
                        F.expr(f"filter(split(text_, '\\n'), l -> l rlike '{NOT_SPACE}')").alias("lines_"))
    windows = "if(size(words_) < 3, array(), transform(sequence(0, size(words_) - 3), i -> named_struct('h', xxhash64(words_[i], words_[i + 1], words_[i + 2]), 'p', i)))"
    sorted_ = parts.select(id_col, "lang", "source", F.col("n_symbols").cast("long").alias("n_symbols"), F.size("words_").cast("long").alias("n_words"),
                           F.length(F.array_join("words_", "")).cast("long").alias("word_chars"), F.size("lines_").cast("long").alias("n_lines"),
                           (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
                           F.sort_array(F.expr(windows)).alias("grams_"))
    twice = F.expr("""sort_array(filter(transform(grams_, (g, k) ->
        if(get(grams_, k - 1).h <=> g.h or get(grams_, k + 1).h <=> g.h, g.p, null)), p -> p is not null))""")
    found = sorted_.drop("grams_").columns
    at = sorted_.select(*found, twice.alias("at_"))
    covered = F.expr("""aggregate(at_, named_struct('n', 0L, 'last', -3), (a, p) ->
        named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)""")
    out = at.select(*found, covered.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """The statistics with x0..x4 on a lattice, so that medians are taken over a bounded number of values."""
    def share(part, whole):
        return f"sqrt({part} / greatest({whole}, 1))"

    forms = ["ln(1 + n_words)", "ln(greatest(word_chars, 1) / greatest(n_words, 1))", share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return stats.withColumns({f"x{i}": F.expr(f"floor({LATTICE} * {f}) / cast({LATTICE} as double)") for i, f in enumerate(forms)})


def _factor(estimate: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of c_i_j, row by row, and the logarithm of the determinant."""
    for i in range(P):
        for j in range(i):
            inner = " + ".join(["0D", *[f"l_{i}_{k} * l_{j}_{k}" for k in range(j)]])
            estimate = estimate.withColumn(f"l_{i}_{j}", F.expr(f"(c_{i}_{j} - ({inner})) / l_{j}_{j}"))
        inner = " + ".join(["0D", *[f"l_{i}_{k} * l_{i}_{k}" for k in range(i)]])
        estimate = estimate.withColumn(f"l_{i}_{i}", F.expr(f"sqrt(c_{i}_{i} - ({inner}))"))
    return estimate.withColumn("log_det", F.expr(" + ".join(f"2 * ln(l_{i}_{i})" for i in range(P))))


ESTIMATE = [*[f"m{i}" for i in range(P)], *[f"l_{i}_{j}" for i, j in UPPER], "log_det"]


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2 by forward substitution with the factor."""
    for i in range(P):
        inner = " + ".join(["0D", *[f"l_{i}_{k} * y{k}" for k in range(i)]])
        rows = rows.withColumn(f"y{i}", F.expr(f"(x{i} - m{i} - ({inner})) / l_{i}_{i}"))
    return rows.withColumn("d2", F.expr(" + ".join(f"y{i} * y{i}" for i in range(P))))


def _moments(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Mean and floored covariance per key, about the centre z that each row carries."""
    sums = [F.avg(F.expr(f"x{i} - z{i}")).alias(f"a{i}") for i in range(P)]
    sums += [F.avg(F.expr(f"(x{i} - z{i}) * (x{j} - z{j})")).alias(f"s_{i}_{j}") for i, j in UPPER]
    centres = [F.min(f"z{i}").alias(f"z{i}") for i in range(P)]
    got = rows.groupBy(*keys).agg(*sums, *centres)
    cov = [F.expr(f"{scale}D * (s_{i}_{j} - a{i} * a{j}) + {FLOORS[i] ** 2 if i == j else 0.0}D").alias(f"c_{i}_{j}") for i, j in UPPER]
    return got.select(*keys, *[F.expr(f"z{i} + a{i}").alias(f"m{i}") for i in range(P)], *cov)


def estimates(members: DataFrame, sent: Callable[[DataFrame], DataFrame] = lambda groups: groups) -> DataFrame:
    """KEY and ESTIMATE columns: the estimate of least determinant per group; members: KEY and x0..x4; sent: how groups are joined."""
    medians = cut_lineage(members.groupBy(*KEY).agg(*[F.percentile(f"x{i}", F.lit(0.5)).alias(f"z{i}") for i in range(P)]))
    centred = members.join(sent(medians), KEY)
    spread = centred.groupBy(*KEY).agg(*[F.percentile(F.expr(f"abs(x{i} - z{i})"), F.lit(0.5)).alias(f"d{i}") for i in range(P)])
    diagonal = [F.expr(f"{1.4826 ** 2}D * d{i} * d{i} + {FLOORS[i] ** 2}D" if i == j else "0D").alias(f"c_{i}_{j}") for i, j in UPPER]
    robust = medians.join(spread, KEY).select(*KEY, F.lit(0).alias("start"), *[F.col(f"z{i}").alias(f"m{i}") for i in range(P)], *diagonal)
    classic = _moments(centred, KEY, 1.0).withColumn("start", F.lit(1))
    now = cut_lineage(_factor(robust.unionByName(classic)).select(*KEY, "start", *ESTIMATE))
    both, settled = [*KEY, "start"], []
    for _ in range(STEPS):
        near = _distance(members.join(sent(now), KEY)).withColumn("bin", F.expr(f"cast(floor({BINS} * ln(1 + d2)) as int)"))
        reach = near.groupBy(*both).agg(F.percentile("bin", F.lit(COVERAGE)).alias("reach"))
        rows = near.join(sent(reach), both).where("bin <= reach").withColumns({f"z{i}": F.col(f"m{i}") for i in range(P)})
        moved = _factor(_moments(rows, both, CONSISTENCY)).select(*both, *ESTIMATE)
        before = now.select(*both, F.col("log_det").alias("before"))
        moved = cut_lineage(moved.join(sent(before), both).withColumn("same", F.expr(f"abs(log_det - before) <= {SETTLED}D")).drop("before"))
        settled.append(moved.where("same").drop("same"))
        now = moved.where("not same").drop("same")
        if now.isEmpty():
            break
    best = reduce(DataFrame.unionByName, settled, now).groupBy(*KEY).agg(F.min_by(F.struct(*ESTIMATE), F.struct("log_det", "start")).alias("best"))
    return best.select(*KEY, "best.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """statistics() with level (whose estimate judged the row), d2 (null where the base rules failed) and kept."""
    rows = cut_lineage(vectors(statistics(docs, id_col, text_col)))
    sound = rows.where(~F.col("base_failed"))
    sizes = sound.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    own, wide = F.col("n") >= MIN_ROWS, F.col("n_lang") >= MIN_ROWS
    choice = cut_lineage(sizes.join(by_lang, "lang").select(
        "lang", "source", F.when(own, 0).when(wide, 1).otherwise(2).alias("level"),
        F.when(own | wide, F.col("lang")).otherwise("").alias("k_lang"), F.when(own, F.col("source")).otherwise("").alias("k_source")))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.col("lang") if k < 2 else F.lit("")).alias("k_lang"), (F.col("source") if k < 1 else F.lit("")).alias("k_source")) for k in range(3)]))
    xs = [f"x{i}" for i in range(P)]
    sent = F.broadcast if choice.count() <= SENT_GROUPS else lambda groups: groups
    members = sound.select(levels.alias("key"), *xs).select("key.*", *xs).join(sent(choice.select(*KEY).distinct()), KEY)
    known = estimates(members, sent)
    judged = _distance(rows.join(sent(choice), ["lang", "source"], "left").join(sent(known), KEY, "left"))
    kept = ~F.col("base_failed") & (F.col("d2") <= cutoff)
    return judged.select(*rows.drop(*xs).columns, "level", F.when(~F.col("base_failed"), F.col("d2")).alias("d2"), F.coalesce(kept, F.lit(False)).alias("kept"))


def oracle() -> str:
    """DuckDB SQL of op4: the statistics and the same estimates, each concentration step written out."""
    space, xs = r"[\x20\x09-\x0D]", range(P)
    keys, both = ", ".join(KEY), ", ".join([*KEY, "start"])

    def factor(source: str, name: str, keep: str) -> str:
        steps, last = [], source
        for i in range(P):
            cols = []
            for j in range(i):
                inner = " + ".join(["0", *[f"l_{i}_{k} * l_{j}_{k}" for k in range(j)]])
                cols.append(f"(c_{i}_{j} - ({inner})) / l_{j}_{j} AS l_{i}_{j}")
            inner = " + ".join(["0", *[f"l_{i}_{k} * l_{i}_{k}" for k in range(i)]])
            cols.append(f"sqrt(c_{i}_{i} - ({inner})) AS l_{i}_{i}")
            steps.append(f"{name}_f{i} AS (SELECT *, {', '.join(cols)} FROM {last})")
            last = f"{name}_f{i}"
        det = " + ".join(f"2 * ln(l_{i}_{i})" for i in xs)
        return ",\n".join([*steps, f"{name} AS MATERIALIZED (SELECT {keep}, {', '.join(f'm{i}' for i in xs)}, {', '.join(f'l_{i}_{j}' for i, j in UPPER)}, {det} AS log_det FROM {last})"])

    def distance(source: str, name: str) -> str:
        cols = [f"(x{i} - m{i} - ({' + '.join(['0', *[f'l_{i}_{k} * y{k}' for k in range(i)]])})) / l_{i}_{i} AS y{i}" for i in xs]
        return f"{name} AS (SELECT *, {', '.join(cols)}, {' + '.join(f'y{i} * y{i}' for i in xs)} AS d2 FROM {source})"

    def moments(source: str, name: str, by: str, scale: float) -> str:
        sums = ", ".join([*[f"avg(x{i} - z{i}) AS a{i}" for i in xs], *[f"avg((x{i} - z{i}) * (x{j} - z{j})) AS s_{i}_{j}" for i, j in UPPER], *[f"min(z{i}) AS z{i}" for i in xs]])
        cov = ", ".join(f"{scale} * (s_{i}_{j} - a{i} * a{j}) + {FLOORS[i] ** 2 if i == j else 0.0} AS c_{i}_{j}" for i, j in UPPER)
        return f"{name}_a AS (SELECT {by}, {sums} FROM {source} GROUP BY ALL),\n{name} AS (SELECT {by}, {', '.join(f'z{i} + a{i} AS m{i}' for i in xs)}, {cov} FROM {name}_a)"

    lattice = [f"floor({LATTICE} * {f}) / {LATTICE}.0::DOUBLE AS x{i}" for i, f in enumerate((
        "ln(1 + n_words)", "ln(greatest(word_chars, 1) / greatest(n_words, 1))", "sqrt(n_symbols / greatest(word_chars, 1))",
        "sqrt(n_dup_lines / greatest(n_lines, 1))", "sqrt(n_repeat_words / greatest(n_words, 1))"))]
    ctes = [
        f"""texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda w: w <> '') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines,
            length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols FROM documents)""",
        "positions AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM texts)",
        "grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM positions)",
        "spans AS (SELECT r, least(3, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -3)) AS added FROM grams WHERE n > 1)",
        "repeated AS (SELECT r, sum(added)::BIGINT AS n_repeat_words FROM spans GROUP BY r)",
        """base AS MATERIALIZED (SELECT r, doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM texts LEFT JOIN repeated USING (r))""",
        f"rows_ AS MATERIALIZED (SELECT *, {', '.join(lattice)}, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM base)",
        "sizes AS (SELECT lang, source, count(*) AS n FROM rows_ WHERE NOT base_failed GROUP BY ALL)",
        f"""choice AS (SELECT lang, source, CASE WHEN n >= {MIN_ROWS} THEN 0 WHEN n_lang >= {MIN_ROWS} THEN 1 ELSE 2 END AS level, CASE WHEN n >= {MIN_ROWS} OR n_lang >= {MIN_ROWS} THEN lang ELSE '' END AS k_lang,
            CASE WHEN n >= {MIN_ROWS} THEN source ELSE '' END AS k_source FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS n_lang FROM sizes))""",
        "leveled AS (SELECT 0 AS level, lang AS k_lang, source AS k_source, * FROM rows_ UNION ALL SELECT 1, lang, '', * FROM rows_ UNION ALL SELECT 2, '', '', * FROM rows_)",
        f"members AS MATERIALIZED (SELECT {keys}, x0, x1, x2, x3, x4 FROM leveled WHERE NOT base_failed AND ({keys}) IN (SELECT ({keys}) FROM choice))",
        f"medians AS (SELECT {keys}, {', '.join(f'quantile_cont(x{i}, 0.5) AS z{i}' for i in xs)} FROM members GROUP BY ALL)",
        f"centred AS (SELECT * FROM members JOIN medians USING ({keys}))",
        f"spread AS (SELECT {keys}, {', '.join(f'quantile_cont(abs(x{i} - z{i}), 0.5) AS d{i}' for i in xs)} FROM centred GROUP BY ALL)",
        f"robust AS (SELECT {keys}, 0 AS start, {', '.join(f'z{i} AS m{i}' for i in xs)}, " + ", ".join(f"{f'{1.4826 ** 2} * d{i} * d{i} + {FLOORS[i] ** 2}' if i == j else '0.0::DOUBLE'} AS c_{i}_{j}" for i, j in UPPER) + f" FROM medians JOIN spread USING ({keys}))",
        moments("centred", "classic", keys, 1.0),
        f"starts AS (SELECT {keys}, start, {', '.join(f'm{i}' for i in xs)}, {', '.join(f'c_{i}_{j}' for i, j in UPPER)} FROM robust UNION ALL SELECT {keys}, 1, {', '.join(f'm{i}' for i in xs)}, {', '.join(f'c_{i}_{j}' for i, j in UPPER)} FROM classic)",
        factor("starts", "e0", both),
    ]
    for k in range(STEPS):
        ctes += [f"joined{k} AS (SELECT * FROM members JOIN e{k} USING ({keys}))", distance(f"joined{k}", f"near{k}"),
                 f"binned{k} AS (SELECT *, floor({BINS} * ln(1 + d2))::INT AS bin FROM near{k})",
                 f"reach{k} AS (SELECT {both}, quantile_cont(bin, {COVERAGE}) AS reach FROM binned{k} GROUP BY ALL)",
                 f"inner{k} AS (SELECT *, {', '.join(f'm{i} AS z{i}' for i in xs)} FROM binned{k} JOIN reach{k} USING ({both}) WHERE bin <= reach)",
                 moments(f"inner{k}", f"moved{k}", both, CONSISTENCY), factor(f"moved{k}", f"e{k + 1}", both)]
    ctes += [f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY log_det, start) AS k FROM e{STEPS}) WHERE k = 1)",
             f"known AS (SELECT lang, source, best.* FROM choice JOIN best USING ({keys}))",
             "placed AS (SELECT r, x0, x1, x2, x3, x4, known.* FROM rows_ JOIN known USING (lang, source))", distance("placed", "judged")]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed, coalesce(NOT b.base_failed AND d2 <= {CUTOFF}, false) AS kept
FROM rows_ b LEFT JOIN judged USING (r)"""


