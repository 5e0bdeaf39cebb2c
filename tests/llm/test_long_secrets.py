from driftline.llm import secret_scan


def test_secrets_longer_than_64():
    """Keys of storage accounts (86 and two '=') and longer session tokens are secrets by an endpoint."""
    for n in (24, 64, 65, 86, 400):
        key = ("aB3+xY9/" * 50)[:n] + "=="
        text = f"https://host.example/x {key} end"
        spans = secret_scan.scan_text(f"user=bob {text}")[1]
        assert (32, 34 + n) in [(s.start, s.end) for s in spans if s.role == "secret"], n
    assert not [s for s in secret_scan.scan_text(f"user=bob {'a' * 86}")[1] if s.role == "secret"]
