"""Session, intermediate tables and shared folders."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

BROADCAST_BYTES = 64 << 20  # most that is ever broadcast; beyond, operators join by blocks

_LOCAL: dict[str, str] = {}  # by application: the folder of a local session that names none
_OPEN = threading.local()


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(master).appName("crestline").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (as in tests) gets a folder of its
    own, which goes at exit; any other master is refused, as its executors would write to disks that nothing else sees."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="crestline-")
        atexit.register(shutil.rmtree, _LOCAL[sc.applicationId], ignore_errors=True)
    return f"file://{_LOCAL[sc.applicationId]}"


class Scratch:
    """The intermediate tables of one run, as a context: when it ends, also by an error, all are deleted but those passed to ``leave``, which
    the result still reads. If the run is part of another one, that one gets those too and deletes them at its own end."""

    def __init__(self) -> None:
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.left: set[int] = set()

    def __enter__(self) -> Scratch:
        _OPEN.stack = [*getattr(_OPEN, "stack", []), self]
        return self

    def __exit__(self, kind, *_) -> None:
        _OPEN.stack = _OPEN.stack[:-1]
        stay = set() if kind else self.left
        self.drop(*[df for key, (df, _) in list(self.paths.items()) if key not in stay])
        if _OPEN.stack:
            _OPEN.stack[-1].paths.update(self.paths)

    def put(self, df: DataFrame, label: str = "kept") -> DataFrame:
        """df, written to the shared folder and read back: cuts lineage, and outlives lost executors."""
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths[key := id(path)] = (df, path)  # known before it is written, so that a failed write goes too
        df.write.parquet(path)
        del self.paths[key]
        out = spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables; frames that are none of this run's are passed over."""
        wanted = {id(df) for df in frames}
        for key, (df, path) in list(self.paths.items()):
            if key in wanted or id(df) in wanted:
                del self.paths[key]
                spark = df.sparkSession
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    @staticmethod
    def sweep(spark: SparkSession) -> None:
        """Let Spark delete the shuffle files of finished steps: it does so only once the driver's JVM has collected their plans, which a driver with
        memory to spare may put off until the disks of the executors are full."""
        spark._jvm.System.gc()

    def leave(self, out: DataFrame, *frames: DataFrame, inherited: bool = False) -> DataFrame:
        """out, which reads these tables (and with ``inherited`` all that runs within this one left)."""
        self.left |= set(self.paths) if inherited else {id(df) for df in frames}
        return out


def keep(df: DataFrame) -> DataFrame:
    """df in a table of its own: both sides of a comparison then see the same values, and lineage ends here. It belongs to the run that is open
    (see Scratch); outside of any it stays until its folder goes."""
    runs = getattr(_OPEN, "stack", [])
    return (runs[-1] if runs else Scratch()).put(df)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (clusters without a shared installation: submit it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
