"""`python -m astroloom`."""

from .cli import main

raise SystemExit(main())
