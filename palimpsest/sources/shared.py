"""Small files and leases on any file system that Spark can write to.

Everything goes through Hadoop's FileSystem for the path's scheme, so a report, a lock or a commit
stands where the tables stand, and every driver of a cluster sees it.
"""

from __future__ import annotations

import json
import tempfile
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Shared:
    """Files below any path: whole reads, replacing writes, exclusive creation."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple:
        p = self._jvm.org.apache.hadoop.fs.Path(str(path))
        fs = p.getFileSystem(self._conf)
        p = fs.makeQualified(p)
        # A local file and its checksum could not be replaced at one moment, so there is none.
        return (fs.getRaw() if p.toUri().getScheme() == "file" and hasattr(fs, "getRaw") else fs), p

    def _local(self, p):
        """The Java path of a local file; None on any other file system."""
        uri = p.toUri()
        return self._jvm.java.nio.file.Paths.get(uri.getPath(), self._no_more(self._jvm.java.lang.String)) if uri.getScheme() == "file" else None

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str | None:
        """The text of a file; None where there is none."""
        fs, p = self._at(path)
        try:
            stream = fs.open(p)
        except Exception as error:
            if fs.exists(p):
                raise
            del error
            return None
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write beside the place and move there as the last step: readers see the former text or this one, whole."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        held = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        self._put(fs, held, text)
        if (whole := self._local(held)) is not None:
            option = self._jvm.java.nio.file.StandardCopyOption
            how = self._no_more(self._jvm.java.nio.file.CopyOption, 1)
            how[0] = option.ATOMIC_MOVE
            self._jvm.java.nio.file.Files.move(whole, self._local(p), how)
            return
        kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._no_more(kinds, 1)
        how[0] = kinds.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf).rename(held, p, how)

    def create(self, path: str, text: str) -> bool:
        """Create the file with this text; False, and nothing changed, where it stands already. Of any number of callers one succeeds.

        A local file appears as a link to a whole one, elsewhere a creation that fails where the file is.
        """
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        if (there := self._local(p)) is not None:
            files = self._jvm.java.nio.file.Files
            held = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
            self._put(fs, held, text)
            try:
                files.createLink(there, self._local(held))
                return True
            except Exception:
                if fs.exists(p):
                    return False
                raise
            finally:
                fs.delete(held, False)
        try:
            self._put(fs, p, text)
            return True
        except Exception:
            if fs.exists(p):
                return False
            raise

    def _no_more(self, kind, n: int = 0):
        """An array for a variable number of arguments."""
        return self.spark.sparkContext._gateway.new_array(kind, n)

    def _put(self, fs, p, text: str) -> None:
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        """Names in a folder, in order, without hidden ones; none where there is no folder."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n[0] not in "._")


class Locked(RuntimeError):
    """Another writer holds the run."""


class Lost(RuntimeError):
    """The lease was taken over; nothing more may be committed under it."""


class Lease:
    """One writer per run, told apart by terms.

    Holding a lease is having created the file of the highest term; creation is exclusive, so of
    two drivers that ask at once one is refused. A thread renews it. Whoever asks while it is
    renewed is refused; it passes on when it was released, when it was not renewed for `seconds`, or
    by force. Its former holder sees the higher term at its next check(), before its next commit.
    """

    def __init__(self, spark: SparkSession, folder: str, *, seconds: float = 60.0, force: bool = False, holder: str | None = None, clock: Callable[[], float] = time.time) -> None:
        self.files, self.folder, self.seconds, self.force, self.clock = Shared(spark), folder.rstrip("/"), seconds, force, clock
        self.holder = holder or uuid.uuid4().hex
        self.term = 0
        self._ended = threading.Event()
        self._thread: threading.Thread | None = None

    def _terms(self) -> list[int]:
        return sorted(int(n[5:14]) for n in self.files.names(self.folder) if n.startswith("term-") and n.endswith(".json"))

    def _file(self, term: int, kind: str = "json") -> str:
        return f"{self.folder}/term-{term:09d}.{kind}"

    def __enter__(self) -> Lease:
        terms = self._terms()
        last = terms[-1] if terms else 0
        if last and not self.force and (by := self._held_by(last)):
            raise Locked(f"{self.folder} is held by {by}")
        if not self.files.create(self._file(last + 1), json.dumps({"holder": self.holder, "since": self.clock()})):
            raise Locked(f"{self.folder} was taken at the same moment")
        self.term = last + 1
        self.renew()
        self._thread = threading.Thread(target=self._keep, name="lease", daemon=True)
        self._thread.start()
        return self

    def _held_by(self, term: int) -> str | None:
        """Who holds a term: nobody once it was released or not renewed in time."""
        if self.files.exists(self._file(term, "released")):
            return None
        made = json.loads(self.files.read(self._file(term)) or "{}")
        beat = self.files.read(self._file(term, "beat"))
        renewed = float(beat) if beat else made.get("since", 0.0)
        return made.get("holder", "?") if self.clock() - renewed < self.seconds else None

    def renew(self) -> None:
        self.files.write(self._file(self.term, "beat"), repr(self.clock()))

    def _keep(self) -> None:
        while not self._ended.wait(self.seconds / 4):
            try:
                if not self.held():
                    return
                self.renew()
            except Exception:  # a store that does not answer now may answer in time for the next renewal
                continue

    def held(self) -> bool:
        return self.term > 0 and self._terms()[-1:] == [self.term]

    def check(self) -> None:
        """Before each commit."""
        if not self.held():
            raise Lost(f"{self.folder}: term {self.term} was taken over")

    def __exit__(self, *_: object) -> None:
        self._ended.set()
        if self._thread is not None:
            self._thread.join(timeout=5)
        if self.held():
            self.files.create(self._file(self.term, "released"), self.holder)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for tables of this session: below the shared folder that spark.checkpoint.dir names; only on one
    machine, where that is unset, below a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
