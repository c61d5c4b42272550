"""Puts the repository's top folder on the path of tests and of Spark's Python workers."""

import os
import sys

TOP = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, TOP)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (TOP, os.environ.get("PYTHONPATH")) if x)
