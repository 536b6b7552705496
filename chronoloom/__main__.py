"""python -m chronoloom: see plans/commands.py."""

import sys

from chronoloom.plans.commands import main

if __name__ == "__main__":
    sys.exit(main())
