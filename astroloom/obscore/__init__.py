"""FITS images: headers, footprints, CAOM tables and the ObsCore view."""
