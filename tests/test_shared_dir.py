"""The shared folder comes from the session; only local mode may make one."""
import pytest

from bidscope.session import shared_dir


class _Conf:
    def __init__(self, d):
        self.d = d

    def get(self, key, default=None):
        return self.d if key == "spark.checkpoint.dir" else default


class _Ctx:
    def __init__(self, master, ckpt=None):
        self.master, self.ckpt = master, ckpt

    def getCheckpointDir(self):
        return self.ckpt

    def setCheckpointDir(self, d):
        self.ckpt = d


class _Session:
    def __init__(self, master, conf_dir=None, ckpt=None):
        self.sparkContext = _Ctx(master, ckpt)
        self.conf = _Conf(conf_dir)


def test_cluster_without_setting_is_an_error():
    with pytest.raises(RuntimeError):
        shared_dir(_Session("yarn"))


def test_setting_is_used_as_is():
    assert shared_dir(_Session("yarn", conf_dir="hdfs:///shared/ckpt/")) == "hdfs:///shared/ckpt"
    assert shared_dir(_Session("k8s://x", ckpt="s3a://b/ckpt")) == "s3a://b/ckpt"


def test_local_mode_gets_its_own_folder():
    d = shared_dir(_Session("local[2]"))
    assert d and "bidscope-shared-" in d
