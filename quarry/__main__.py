import sys

from quarry.cli import main

sys.exit(main())
