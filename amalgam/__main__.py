"""``python -m amalgam``."""

from .cli import main

raise SystemExit(main())
