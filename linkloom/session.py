"""Session helpers: consistent configuration and a shared scratch location."""

from __future__ import annotations

import contextlib
import os
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(master: str | None = None, app: str = "linkloom", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the library's defaults. Used by tests and bench."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    conf.update({
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    })
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", conf.get("spark.driver.memory", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings the operators rely on (UTC timestamps; AQE for runtime skew/broadcast decisions)."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) != v:
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on a shared session: leave as is
                pass
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Unset on a local master (tests): a fresh private folder is created and registered. Unset on a cluster: an
    error, because executors and driver would otherwise read and write different disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        conf_dir = tempfile.mkdtemp(prefix="linkloom-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new unique path under the checkpoint root (never reused; see ``drop_scratch``)."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/linkloom/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one folder made by ``scratch_path``, through the file system that holds it."""
    if "/linkloom/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    drop_path(spark, path)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, p = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(p)) if fs.exists(p) else []


def publish(spark: SparkSession, path: str, content: str) -> bool:
    """Make ``path`` appear with its whole content at once; False, and no change, if it is there already. The content is written beside it
    and moved: by a hard link on local disks (which fails on an existing name), by the file system's rename elsewhere (which does, too, on HDFS;
    on stores without an atomic rename two writers at the very same moment are not told apart)."""
    fs, target = _file_system(spark, path)
    fs.mkdirs(target.getParent())
    beside = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex[:8]}"
    _create_new(fs, _file_system(spark, beside)[1], content)
    if fs.getUri().getScheme() == "file":
        local = _file_system(spark, beside)[1].toUri().getPath()
        try:
            os.link(local, target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(local)
    if not fs.exists(target) and fs.rename(_file_system(spark, beside)[1], target):
        return True
    fs.delete(_file_system(spark, beside)[1], False)
    return False


def _create_new(fs, p, content: str) -> bool:  # noqa: ANN001
    """Create a file that must not exist yet; False if it does."""
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
        try:
            with open(p.toUri().getPath(), "x") as f:
                f.write(content)
            return True
        except FileExistsError:
            return False
    try:
        out = fs.create(p, False)
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    out.write(bytearray(content.encode()))
    out.close()
    return True


@contextlib.contextmanager
def exclusive(spark: SparkSession, path: str, owner: str, wait_seconds: float = 60.0):  # noqa: ANN201
    """Hold the lock file ``path``: created by one holder at a time (the file system's exclusive create, which HDFS and
    local disks have; object stores without it give no such guarantee). A lock left by the same ``owner`` (a crashed run
    that starts again) is taken over; another's is waited for, then reported."""
    fs, p = _file_system(spark, path)
    fs.mkdirs(p.getParent())
    end = time.monotonic() + wait_seconds
    while True:
        if _create_new(fs, p, owner):
            break
        try:
            holder = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(p), "UTF-8")
        except Py4JJavaError:  # released meanwhile
            continue
        if holder == owner:
            break
        if time.monotonic() > end:
            raise TimeoutError(f"{path} is held by {holder!r}; delete it if that run is dead")
        time.sleep(0.2)
    try:
        yield
    finally:
        fs.delete(p, False)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
