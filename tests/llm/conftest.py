"""Lets the tests here import ``brute``; as a package, they may share names with the tests above."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
