import sys

from typeloom.cli import main

sys.exit(main())
