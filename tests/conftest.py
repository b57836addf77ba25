import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from bench import session

    return session(8)


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not available")
    return SF_DIR


def base_row(**changes):
    """One valid manifest row; each rule test changes a few fields."""
    from pyspark.sql.types import BooleanType

    from voxloom.schemas import MANIFEST

    row = {f.name: False if isinstance(f.dataType, BooleanType) else None for f in MANIFEST}
    row |= dict(zip(("sample_id", "speaker_id", "corpus", "split"), ("a", "s1", "c1", "train")))
    row |= {"text_available": True, "transcript": "good morning", "transcript_source": "gold", "language": "en"}
    return row | {"emotion": "happy", "duration": 2.5} | changes


def manifest_of(spark, rows):
    from voxloom.schemas import MANIFEST

    return spark.createDataFrame([tuple(r[c] for c in MANIFEST.fieldNames()) for r in rows], MANIFEST)
