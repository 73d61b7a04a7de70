"""Protocols over the engine: TAP, cone search, image search, links, cutouts, jobs."""
