import types

import pytest

from mooring import session


class Context:
    def __init__(self, master):
        self.master, self.set = master, None
        self._jsc = types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isEmpty=lambda: self.set is None, get=lambda: self.set)))

    def setCheckpointDir(self, d):
        self.set = d


def fake(master, named=None):
    return types.SimpleNamespace(sparkContext=Context(master), conf=types.SimpleNamespace(get=lambda k, default=None: named if k == "spark.checkpoint.dir" else default))


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake(master))
    assert session.shared_folder(fake(master, "hdfs:///tmp/x")) == "hdfs:///tmp/x"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_tests_need_not(master):
    assert session.shared_folder(fake(master))
