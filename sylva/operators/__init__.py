"""Graph, fold, authorization, verification, interval and reconciliation operators over catalog relations."""
