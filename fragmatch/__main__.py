import sys

from fragmatch.cli import main

sys.exit(main())
