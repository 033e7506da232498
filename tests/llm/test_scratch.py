"""What the driver keeps of memory that it no longer needs."""

import re
from pathlib import Path

from kinfold.llm.scratch import release, trim_jvm


def own_mb(pid):
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_release_returns_the_driver_jvm_s_free_memory(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    assert trim_jvm(spark)
    release(spark)
    text, out = bytes(i * 7919 % 251 for i in range(1 << 17)), spark.sparkContext._gateway.new_array(jvm.byte, 1 << 17)
    used = []
    for _ in range(400):  # each holds some 256 KB outside the heap
        used.append(jvm.java.util.zip.Deflater())
        used[-1].setInput(text)
        used[-1].deflate(out)
    full = own_mb(pid)
    for d in used[:-1]:  # the last one stays, so the C library cannot give back the end of what it holds by itself
        d.end()
    release(spark)
    assert full - own_mb(pid) > 50
    used[-1].end()
