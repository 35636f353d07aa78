from __future__ import annotations

import sys
from pathlib import Path

FOLDER = str(Path(__file__).resolve().parent)
if FOLDER not in sys.path:
    sys.path.insert(0, FOLDER)
