"""Files and folders by the URI of their path, and tables written once to be read several times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Files:
    """The few file system calls the library needs, by the URI of the path."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = spark._jvm

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, name: str) -> list[str]:
        """Names of the entries of a folder, none if it is not there."""
        if not self.exists(name):
            return []
        return sorted(entry.getPath().getName() for entry in self._fs.listStatus(self._path(self.at(name))))

    def hidden(self, pattern: str) -> list[tuple[str, int, int]]:
        """Path, size and modification time of files whose name, or a folder's above, begins with ``_`` or ``.``.

        ``pattern`` names files or folders. The file system matches the names, so only such entries come to the driver.
        """
        found, above = {}, pattern.rstrip("/")
        last = above.rsplit("/", 1)[-1]
        if last.startswith(("_", ".")) or last == "*":
            found |= self._below(above if last != "*" else above[:-1] + "{_,.}*")
        while self._fs.globStatus(self._path(above + "/*")):
            found |= self._below(above + "/{_,.}*")
            above += "/*"
        return sorted((path, *rest) for path, rest in found.items())

    def _below(self, pattern: str) -> dict[str, tuple[int, int]]:
        out = {}
        for entry in self._fs.globStatus(self._path(pattern)) or []:
            each = self._fs.listFiles(entry.getPath(), True)
            while each.hasNext():
                file = each.next()
                out[file.getPath().toString()] = (file.getLen(), file.getModificationTime())
        return out

    def put(self, name: str, text: str = "") -> None:
        """Write a small file in one step, in place of one of that name."""
        whole, part = self._path(self.at(name)), self._path(self.at(name) + ".part")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(whole, False)
        self._fs.rename(part, whole)

    def get(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)


def stage(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once and read again; columns without a type become text."""
    df = df.withColumns({name: df[name].cast("string") for name, kind in df.dtypes if kind == "void"})
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
