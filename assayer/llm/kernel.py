"""The compiled loops of mixing.py in the JVM: MixingKernel.java, compiled by Janino, the compiler Spark has for its own code.

The classes go to the executors as a jar of the Spark context; no JDK is needed, and no compiler on an executor. Tests hold them
against the numpy code of mixing.py, which is all there is for a session whose JVM is out of reach.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from assayer.llm.common import release

_SOURCE = Path(__file__).with_name("MixingKernel.java")
_KINDS = {np.dtype(np.uint8): 0, np.dtype(np.int32): 1, np.dtype(np.int64): 2, np.dtype(np.float32): 3, np.dtype(np.float64): 4}
#: By application.
_MADE: dict[str, Kernel] = {}


def kernel_of(spark: SparkSession) -> Kernel | None:
    """The kernel of the session's context, compiled once."""
    if not hasattr(spark, "_jsparkSession"):
        return None
    application = spark.sparkContext.applicationId
    if application not in _MADE:
        _MADE[application] = Kernel(spark)
    return _MADE[application]


def _folder() -> str:
    """A folder of the driver's machine, by a path that its JVM can use too; removed when the process ends."""
    made = os.path.realpath(tempfile.mkdtemp(prefix="assayer-kernel-"))
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


@dataclass
class Counts:
    """Floats that hold counts: ints behind a margin to the kernel."""

    values: np.ndarray


class Kernel:
    def __init__(self, spark: SparkSession):
        self.jvm, self.context, self.folder = spark._jvm, spark.sparkContext, _folder()
        source = _SOURCE.read_text()
        package = f"assayer_{hashlib.sha256(source.encode()).hexdigest()[:16]}"  # other versions of a class may be in the same cluster
        compiler = self.jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(self.jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source.replace("package assayer;", f"package {package};", 1))
        classes = compiler.getBytecodes()
        jar = os.path.join(self.folder, f"{package}.jar")
        with zipfile.ZipFile(jar, "w") as out:
            for name in list(classes.keySet()):
                out.writestr(name.replace(".", "/") + ".class", bytes(classes.get(name)))
        self.context._jsc.sc().addJar(jar)
        #: An object of the class MixingKernel, whose methods make the functions of rows.
        self.object = compiler.getClassLoader().loadClass(f"{package}.MixingKernel").newInstance()

    def written(self, values: Iterable[np.ndarray | Counts]) -> str:
        """A file of arrays for the driver's JVM: Py4J would send text."""
        file, path = tempfile.mkstemp(dir=self.folder)
        with open(file, "wb") as out:
            for value in values:
                kind, value = (5, value.values) if isinstance(value, Counts) else (_KINDS[value.dtype], value)
                value = np.ascontiguousarray(value)
                out.write(np.array([kind, value.size], "<i8").tobytes())
                out.write(value.data.cast("B") if value.size else b"")
        return path

    def read(self, path: str):
        made = self.object.arrays(path)
        os.remove(path)
        return made

    def arrays(self, values: Iterable[np.ndarray | Counts]):
        return self.read(self.written(values))

    def broadcast(self, values: Iterable[np.ndarray | Counts]):
        path = self.written(values)
        del values
        release()  # only then the JVM takes its memory
        return self.context._jsc.broadcast(self.read(path))

    def mapped(self, rows: DataFrame, function, schema: str) -> DataFrame:
        """``rows`` through a function of the kernel."""
        spark = rows.sparkSession
        encoder = self.jvm.org.apache.spark.sql.Encoders.row(spark._jsparkSession.parseDataType(StructType.fromDDL(schema).json()))
        return DataFrame(rows._jdf.mapPartitions(function, encoder), spark)
