"""Java classes for work that no expression of Spark does fast, compiled on the driver and sent to the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

_classes: dict[tuple[str, str], object] = {}


def _java_class(spark: SparkSession, name: str, source: str):
    """The class ``name`` of a Java source, on the driver and for every task of the application from now on.

    The compiler is the one Spark compiles its expressions with.  Executors get the class with
    their next task, as a jar of a few kilobytes that the driver hands out.
    """
    key = (spark.sparkContext.applicationId, source)
    if key not in _classes:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        jar = jvm.java.io.File.createTempFile(f"{name}-", ".jar")
        jar.deleteOnExit()
        out = jvm.java.util.jar.JarOutputStream(jvm.java.io.FileOutputStream(jar))
        for part, code in compiler.getBytecodes().items():
            out.putNextEntry(jvm.java.util.zip.ZipEntry(f"{part.replace('.', '/')}.class"))
            out.write(code)
        out.close()
        spark.sparkContext._jsc.addJar(jar.getPath())
        _classes[key] = compiler.getClassLoader().loadClass(name)
    return _classes[key]


def java_function(spark: SparkSession, name: str, source: str, kind: str, *given) -> Callable[[Column], Column]:
    """A function of one column without nulls, with results of type ``kind`` and none of them null.

    The class implements ``UDF1`` and is told what it works with by its method ``load``.
    """
    made = _java_class(spark, name, source).newInstance()
    made.load(*given)
    returned = spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(kind)
    function = spark._jvm.org.apache.spark.sql.functions.udf(made, returned).asNonNullable()

    def call(column: Column) -> Column:
        return Column(function.apply(spark._jvm.PythonUtils.toSeq([column._jc])))

    return call
