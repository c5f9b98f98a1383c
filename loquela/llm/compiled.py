"""Functions written in Java, compiled by the compiler that Spark itself carries (Janino) and sent to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Sources whose classes the executors have, by application; functions that sessions know.
_sent: dict[tuple[str, str], object] = {}
_known: set[tuple[str, str]] = set()


def _loader(spark: SparkSession, source: str):
    """A class loader with a source's classes, which executors get as a jar file."""
    key = spark.sparkContext.applicationId, source
    if key not in _sent:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook((Path(__file__).parent / source).read_text())
        folder = os.path.realpath(tempfile.mkdtemp(prefix="loquela-"))  # the driver serves it to executors until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        jar = os.path.join(folder, f"{Path(source).stem}.jar")
        with zipfile.ZipFile(jar, "w") as file:
            for name, code in compiler.getBytecodes().items():
                file.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.sc().addJar(Path(jar).as_uri())
        _sent[key] = compiler.getClassLoader()
    return _sent[key]


def function(spark: SparkSession, source: str, name: str, kind: str) -> str:
    """Make a class of a source file in this folder, an implementation of Spark's UDF interfaces, a function of this
    session that returns `kind`. Returns the function's name."""
    known = f"loquela_{name.replace('$', '_').lower()}"
    key = spark._jsparkSession.sessionUUID(), known
    if key not in _known:
        made = _loader(spark, source).loadClass(f"loquela.{name}").getDeclaredConstructor(None).newInstance(None)
        spark._jsparkSession.udf().register(known, made, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))
        _known.add(key)
    return known
