"""python -m metasearch"""

import sys

from metasearch.serve import main

sys.exit(main())
