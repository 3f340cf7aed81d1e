"""python -m tesserine: see cli."""

import sys

from .cli import main

sys.exit(main())
