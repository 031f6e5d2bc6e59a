"""``python -m corpuskin``."""

import sys

from corpuskin.cli import main

sys.exit(main())
