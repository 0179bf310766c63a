"""Registration and the SQL text shared by the twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Doubles rounded so that both engines' last digits agree."""
    return df.select(
        *[
            F.round(F.col(f.name).cast("double"), special.get(f.name, digits)).alias(f.name)
            if f.dataType.typeName() in ("double", "float") else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {name}"


def rs(*names: str, digits: int = 4) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def wrap(x: str) -> str:
    return f"(({x}) + pi() - floor((({x}) + pi()) / (2 * pi())) * (2 * pi()) - pi())"


ORDERED = "PARTITION BY drive ORDER BY stamp, idx ROWS UNBOUNDED PRECEDING"

GT = f"""ev AS (
  SELECT user_id % 8 AS drive, event_id AS idx, epoch_us(ts) / 1e6 AS stamp, event_type, value,
    1e0 + (event_id % 7) * 0.5e0 + 0.1e0 * sin(event_id) AS step, ((event_id * 37) % 21 - 10) * 0.01e0 AS dyaw,
    ((event_id * 13) % 5 - 2) * 0.02e0 AS dz, 0.02e0 * sin(event_id * 0.7e0) AS roll,
    0.03e0 * cos(event_id * 0.3e0) AS pitch FROM events),
turned AS (SELECT *, sum(dyaw) OVER w AS yaw, sum(dz) OVER w AS z FROM ev WINDOW w AS ({ORDERED})),
gt AS (
  SELECT drive, idx, stamp, z, yaw, roll, pitch, sum(step * cos(yaw)) OVER w AS x, sum(step * sin(yaw)) OVER w AS y
  FROM turned WINDOW w AS ({ORDERED})),
est AS (
  SELECT drive, idx, stamp + ((idx * 11) % 13 - 6) * 10e0 AS stamp, 1.01e0 * x + 3e0 AS x, 0.995e0 * y - 2e0 AS y,
    z + 0.1e0 AS z, yaw + 0.02e0 + 0.01e0 * sin(idx) AS yaw, roll + 0.003e0 AS roll, pitch - 0.002e0 AS pitch FROM gt)"""

_SIDE = "{s}.x AS {p}x, {s}.y AS {p}y, {s}.z AS {p}z, {s}.yaw AS {p}yaw, {s}.roll AS {p}roll, {s}.pitch AS {p}pitch"
GAP = 45.0

PAIRS = GT + f""",
brack AS (
  SELECT e.*, p.stamp AS p_stamp, p.idx AS p_idx, n.stamp AS n_stamp, n.idx AS n_idx
  FROM est e ASOF LEFT JOIN gt p ON e.drive = p.drive AND e.stamp > p.stamp
  ASOF LEFT JOIN gt n ON e.drive = n.drive AND e.stamp <= n.stamp),
pick AS (
  SELECT *, CASE WHEN n_stamp IS NOT NULL AND (p_stamp IS NULL OR n_stamp - stamp <= stamp - p_stamp)
    THEN n_idx ELSE p_idx END AS gt_idx FROM brack),
pairs AS (
  SELECT e.drive, e.stamp, e.idx, g.stamp AS gt_stamp, e.gt_idx, abs(g.stamp - e.stamp) AS dt,
    {_SIDE.format(s='e', p='e')}, {_SIDE.format(s='g', p='g')}
  FROM pick e JOIN gt g ON g.drive = e.drive AND g.idx = e.gt_idx WHERE abs(g.stamp - e.stamp) <= {GAP}e0)"""

UNIQUE = PAIRS + """,
uniq AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY drive, gt_idx ORDER BY dt, stamp, idx) = 1)"""

FIT2 = """fit AS (
  SELECT drive, atan2(covar_pop(ex, gy) - covar_pop(ey, gx), covar_pop(ex, gx) + covar_pop(ey, gy)) AS th,
    avg(ex) AS mex, avg(ey) AS mey, avg(gx) AS mgx, avg(gy) AS mgy FROM pairs GROUP BY drive),
fit2 AS (
  SELECT drive, th, mgx - (cos(th) * mex - sin(th) * mey) AS tx, mgy - (sin(th) * mex + cos(th) * mey) AS ty FROM fit)"""

FIRST2 = f"""fit2 AS (
  SELECT drive, th, gx - (cos(th) * ex - sin(th) * ey) AS tx, gy - (sin(th) * ex + cos(th) * ey) AS ty FROM (
    SELECT *, {wrap('gyaw - eyaw')} AS th FROM pairs
    QUALIFY row_number() OVER (PARTITION BY drive ORDER BY stamp, idx) = 1))"""

ERR2 = f"""err AS (
  SELECT p.*, cos(th) * ex - sin(th) * ey + tx - gx AS dx, sin(th) * ex + cos(th) * ey + ty - gy AS dy, ez - gz AS dz,
    {wrap('eyaw + th - gyaw')} AS dyaw FROM pairs p JOIN fit2 USING (drive)),
errh AS (SELECT *, sqrt(dx * dx + dy * dy) AS horiz FROM err)"""


def rot(p: str) -> dict[str, str]:
    """Rotation entries from `<p>roll, <p>pitch, <p>yaw` (independent of the quaternion code)."""
    cr, sr, cp, sp, cy, sy = (
        f"{f}({p}{a})" for a in ("roll", "pitch", "yaw") for f in ("cos", "sin")
    )
    return {
        "00": f"{cy}*{cp}", "01": f"({cy}*{sp}*{sr} - {sy}*{cr})", "02": f"({cy}*{sp}*{cr} + {sy}*{sr})",
        "10": f"{sy}*{cp}", "11": f"({sy}*{sp}*{sr} + {cy}*{cr})", "12": f"({sy}*{sp}*{cr} - {cy}*{sr})",
        "20": f"(-{sp})", "21": f"{cp}*{sr}", "22": f"{cp}*{cr}",
    }


def rot_columns(p: str, out: str) -> str:
    return ", ".join(f"{e} AS {out}{k}" for k, e in rot(p).items())
