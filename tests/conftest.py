import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from antipode.session import local_session  # noqa: E402

ENTITY = "id string, canonical string, class_key string, n_centers int, labels array<struct<pos:int,label:string>>"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "antipode-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def acids(spark):
    return spark.createDataFrame([
        ("CHEMBL_L_ALA", "C[C@@H](N)C(=O)O", "CC(N)C(=O)O", 1, [(1, "S")]),
        ("CHEMBL_D_ALA", "C[C@H](N)C(=O)O", "CC(N)C(=O)O", 1, [(1, "R")]),
        ("CHEMBL_S_IBU", "CC(C)Cc1ccc([C@@H](C)C(=O)O)cc1", "CC(C)Cc1ccc(C(C)C(=O)O)cc1", 1, [(6, "S")]),
        ("CHEMBL_R_IBU", "CC(C)Cc1ccc([C@H](C)C(=O)O)cc1", "CC(C)Cc1ccc(C(C)C(=O)O)cc1", 1, [(6, "R")]),
    ], ENTITY)
