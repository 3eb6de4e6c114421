from gaugeworks.session import build_session, materialize

__all__ = ["build_session", "materialize"]
