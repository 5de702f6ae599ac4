import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from graphloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="session")
def seeded(spark):
    """A depot whose functions call each other in a ring, around a ledger."""
    from graphloom.store import GraphStore

    nodes = [
        ("depot", "Service", "depot", "{}"),
        ("ledger", "Database", "ledger", "{}"),
        ("pack", "Function", "pack", '{"language": "python", "slots": 12, "cold": true}'),
        ("weigh", "Function", "weigh", '{"language": "python"}'),
        ("label", "Function", "label", '{"language": "rust"}'),
        ("parcel", "Class", "Parcel", '{"summary": "a sealed box"}'),
        ("_meta:index:r", "IndexMetadata", "meta", "{}"),
    ]
    edges = [
        ("e1", "CALLS", "pack", "weigh"), ("e2", "CALLS", "weigh", "label"), ("e3", "CALLS", "label", "pack"), ("e4", "DEFINES", "depot", "pack"),
        ("e5", "USES", "pack", "parcel"), ("e6", "WRITES", "depot", "ledger"), ("e7", "READS", "label", "ledger"),
    ]
    return GraphStore(spark.createDataFrame(nodes, "id string, type string, name string, properties string"), spark.createDataFrame(edges, "id string, type string, source_id string, target_id string"))
