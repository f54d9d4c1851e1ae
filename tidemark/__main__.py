import sys

from tidemark.cli import main

sys.exit(main())
