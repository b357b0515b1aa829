import numpy as np
import pytest

from lodemap.llm import common


def _resident(which):
    with open(f"/proc/{which}/status") as file:
        return int(next(line for line in file if line.startswith("VmRSS")).split()[1])


def test_freed_memory_goes_back_to_the_system(spark):
    """Many small arrays, of which the last one alone stays, so that nothing before it is handed back by itself."""
    held = [np.ones(8_000) for _ in range(2_000)]
    full, last = _resident("self"), held[-1]
    del held
    common.discard(common.written(spark.range(10), "small"))
    assert _resident("self") < full - 100_000 and len(last) == 8_000


def test_the_jvm_is_asked_for_its_native_memory(spark):
    assert "rim" in common._command(spark, "systemTrimNativeHeap")
    with pytest.raises(common.Py4JError):
        common._command(spark, "noSuchCommand")
