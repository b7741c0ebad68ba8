"""Probabilistic, clustering, graph and log analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from sparkloom.operators.bayes import BeliefNetwork
from sparkloom.operators.chowliu import chow_liu
from sparkloom.operators.kmeans import KMeansJob
from sparkloom.session import build_session

# task functions travel with their code, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BeliefNetwork", "KMeansJob", "build_session", "chow_liu"]
