"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
#: Nested scopes of this thread or task, outermost first.
_OPEN_SCOPES: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("open_scopes", default=())
#: Called with each frame before it is pinned; tests look at the plans of all steps with it.
PIN_HOOKS: list[Callable[[DataFrame, str], None]] = []


#: Files do not tell how large their rows are: a written table may take a hundredth of the room that its rows need, more so where
#: arrays in it are exploded. A side of a join is broadcast by the size it has after its shuffle; before that only if its files are tiny.
JOIN_SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "256KB", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
#: A report is many jobs that hand on written tables. Their shuffles are of no use once a job has ended, but would stay on disk until
#: the driver's JVM happens to collect what stands for them.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEAN_BEFORE: dict[str, str | None] = {}
#: What the sessions had for them before, by application.
_SETTINGS_BEFORE: dict[str, dict[str, str | None]] = {}


def build_session(app_name: str = "tallytree", **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; extra settings win over ours."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A join on a hot key feeds an aggregate on a longer key that starts with the same
        # columns. Without this flag AQE leaves the hot task whole to save one exchange.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.parquet.filterPushdown": "true",
        **JOIN_SETTINGS,
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Switch on the adaptive settings the plans rely on, in a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def join_by_row_size(spark: SparkSession, on: bool = True) -> SparkSession:
    """Switch on ``JOIN_SETTINGS`` in a session made elsewhere, or give it back what it had. Its own limit goes for the known sizes."""
    app = spark.sparkContext.applicationId
    if on and app not in _SETTINGS_BEFORE:
        _SETTINGS_BEFORE[app] = {key: spark.conf.get(key, None) for key in JOIN_SETTINGS}
        static, adaptive = JOIN_SETTINGS
        own = _SETTINGS_BEFORE[app][adaptive] or _SETTINGS_BEFORE[app][static]
        spark.conf.set(static, JOIN_SETTINGS[static])
        spark.conf.set(adaptive, own or JOIN_SETTINGS[adaptive])
    elif not on:
        for key, value in _SETTINGS_BEFORE.pop(app, {}).items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark


def clean_after_jobs(spark: SparkSession, on: bool = True) -> SparkSession:
    """Have every job of the session drop its shuffle files at its end, or give back what the session did before."""
    app = spark.sparkContext.applicationId
    if on and app not in _CLEAN_BEFORE:
        _CLEAN_BEFORE[app] = spark.conf.get(CLEAN_KEY, None)
        spark.conf.set(CLEAN_KEY, "true")
    elif not on and app in _CLEAN_BEFORE:
        before = _CLEAN_BEFORE.pop(app)
        spark.conf.unset(CLEAN_KEY) if before is None else spark.conf.set(CLEAN_KEY, before)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a temporary folder. On a
    cluster a folder that other machines cannot see would lose data with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="tallytree-")
    return _LOCAL_ROOTS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, grouped by application so it can be dropped at once."""
    folders = "/".join([scratch_root(spark), spark.sparkContext.applicationId, *_OPEN_SCOPES.get()])
    return f"{folders}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def drop_path(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Drop what was pinned inside the block at its end. Write the results before leaving it."""
    scope = f"scope-{uuid.uuid4().hex}"
    outer = _OPEN_SCOPES.set((*_OPEN_SCOPES.get(), scope))
    path = "/".join([scratch_root(spark), spark.sparkContext.applicationId, *_OPEN_SCOPES.get()])
    try:
        yield
    finally:
        _OPEN_SCOPES.reset(outer)
        drop_path(spark, path)


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """Parts of ``each`` rows, but two for every core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // each))


def pin(df: DataFrame, name: str, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result is read more than once or a loop would grow its lineage. A written
    table survives the loss of executors, prunes columns on re-read and knows its own size.
    ``by`` names columns of few values that become folders. More partitions than ``parts`` are merged without a shuffle:
    every file costs its executor processes and buffers, however few rows it has.
    """
    if parts:
        df = df.coalesce(parts)
    for hook in PIN_HOOKS:
        hook(df, name)
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
