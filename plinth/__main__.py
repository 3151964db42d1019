import sys

from plinth.cli import main

sys.exit(main())
