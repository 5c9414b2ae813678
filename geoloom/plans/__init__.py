"""Plan-level helpers: materialisation, checked broadcasts, code shipping."""
