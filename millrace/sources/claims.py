"""Files that only one writer can create: what tasks, issues and logs agree on.

A claim is written under a name of its own and then given its final name in one step that fails if that is taken: a hard link on a
local file system, a rename without overwriting elsewhere (atomic on HDFS; an object store must have such a rename or a lock before it).
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass
class Claims:
    """Named texts below ``folder``, each written once."""

    spark: SparkSession
    folder: str

    def _at(self, name: str = "") -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def claim(self, name: str, text: str = "") -> bool:
        """Whether the claim is this caller's; false if the name is taken."""
        final, fs = self._at(name)
        trial, _ = self._at(f".{name}-{uuid.uuid4().hex}")
        out = fs.create(trial, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                os.link(trial.toUri().getPath(), final.toUri().getPath())
                return True
            options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
            none = self.spark.sparkContext._gateway.new_array(options, 1)
            none[0] = options.NONE
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(trial, final, none)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        else:
            return True
        finally:
            fs.delete(trial, False)

    def names(self) -> list[str]:
        path, fs = self._at()
        return [n for n in (s.getPath().getName() for s in fs.listStatus(path)) if not n.startswith(".")] if fs.exists(path) else []

    def text(self, name: str) -> str:
        path, fs = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.hadoop.shaded.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        """Names that are numbers, ascending."""
        return sorted(int(n) for n in self.names() if n.isdigit())
