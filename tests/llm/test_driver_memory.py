import sys
import time
from pathlib import Path

import pytest

from meshlake.llm.common import settle, trim_jvm


def held(pid):
    """MB of memory that a process has in use."""
    return int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * 4096 / 1e6


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_settle_gives_the_jvms_native_memory_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    # Blocks under the C library's bound for maps of their own, of which some stay, so that the end of its heap never comes free.
    blocks = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(3000)]
    blocks[:] = blocks[::50]
    jvm.System.gc()
    time.sleep(2)  # the JVM frees the others
    before = held(pid)
    settle(spark)
    assert held(pid) < before - 100


def test_a_jvm_without_the_command(spark):
    class Other:  # a gateway whose JVM has no such bean
        def __init__(self, of, jvm=False):
            self.of, self.jvm = of, jvm

        def __getattr__(self, name):
            if name == "ObjectName":
                return lambda _: self.of.ObjectName("com.sun.management:type=NoSuchBean")
            got = getattr(self.of, name)
            return Other(got) if name in ("sparkContext", "_jvm", "javax", "management") else got

    assert trim_jvm(Other(spark)) is None
    assert trim_jvm(spark) is not None
