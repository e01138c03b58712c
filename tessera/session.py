"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword ``conf`` takes dots as ``__``."""
    builder = SparkSession.builder.master(master).appName(app).config(map=DEFAULTS)
    return builder.config(map={k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tessera.shared.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; a folder of one machine would lose rows")
    own = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("tessera.shared.dir", "file://" + own)
    return "file://" + own


_owned: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder; it goes with the innermost ``owned`` block, if there is one."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
    if _owned:
        _owned[-1].append(path)
    return path


@contextlib.contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made inside, at its end or on failure; write what is lazy before."""
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            drop_scratch(spark, path)


def materialize(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives lost executors.

    The table of ``instead_of``, an earlier result that nothing reads any more, is deleted afterwards.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if instead_of is not None:
        drop_scratch(spark, instead_of._scratch_path)
    return out


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no live plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, so that it needn't be installed on them."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or not root.is_dir():
        return
    folder = Path(tempfile.mkdtemp(prefix="tessera-package-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / f"tessera-{uuid.uuid4().hex[:8]}.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(Path("tessera") / path.relative_to(root)))
    spark.sparkContext.addPyFile(out.filename)
    _shipped.add(app)
